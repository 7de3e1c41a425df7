"""Word packages as rows. The only Python here opens zip and XML, one document at a time;
what the parts mean is decided on the rows (operators/word.py)."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
V = "{urn:schemas-microsoft-com:vml}"

RUN = "struct<kind:string,text:string,fmt:string,link:string,link_no:int,note:string,alt:string>"
SCHEMA = (
    "doc_id string, error string, core string, "
    "styles array<struct<id:string,name:string,based_on:string,outline:int,num_id:string,ilvl:int>>, "
    "nums array<struct<num_id:string,ilvl:int,fmt:string>>, rels array<struct<id:string,target:string,external:boolean>>, "
    f"paras array<struct<ord:int,block:int,place:string,row:int,cell:int,span:int,note:string,style:string,num_id:string,ilvl:int,runs:array<{RUN}>>>, "
    "media array<struct<part:string,bytes:binary>>"
)


def read_packages(files: DataFrame) -> DataFrame:
    """files (doc_id, content) to one row per document with its parts as arrays."""
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([_package(doc_id.as_py(), content.as_py())], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, SCHEMA)


def _package(doc_id: str, data: bytes) -> dict:
    out: dict = {"doc_id": doc_id, "error": None, "core": None, "styles": [], "nums": [], "rels": [], "paras": [], "media": []}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            xml = lambda name: ET.fromstring(z.read(name)) if name in z.namelist() else None
            body = xml("word/document.xml")
            out["core"] = z.read("docProps/core.xml").decode("utf-8", "replace") if "docProps/core.xml" in z.namelist() else None
            out["styles"] = list(_styles(xml("word/styles.xml")))
            out["nums"] = list(_nums(xml("word/numbering.xml")))
            out["rels"] = list(_rels(xml("word/_rels/document.xml.rels")))
            out["paras"] = list(_paras(body.find(W + "body"), xml("word/footnotes.xml")))
            parts = set(z.namelist())
            out["media"] = [{"part": p, "bytes": z.read(p)} for p in sorted({posixpath.normpath(posixpath.join("word", r["target"])) for r in out["rels"] if not r["external"]} & parts) if "/media/" in p]
    except Exception as e:  # noqa: BLE001 -- a broken file is a row with its error
        out |= {"error": f"{type(e).__name__}: {e}", "paras": []}
    return out


def _val(el, default=None):
    return default if el is None else el.get(W + "val", default)


def _int(text, default=None):
    try:
        return int(text)
    except (TypeError, ValueError):
        return default


def _num_pr(ppr) -> tuple[str | None, int | None]:
    num = None if ppr is None else ppr.find(W + "numPr")
    if num is None:
        return None, None
    return _val(num.find(W + "numId"), "0"), _int(_val(num.find(W + "ilvl")), 0)


def _styles(root) -> Iterator[dict]:
    for s in () if root is None else root.iter(W + "style"):
        ppr = s.find(W + "pPr")
        num_id, ilvl = _num_pr(ppr)
        outline = None if ppr is None else ppr.find(W + "outlineLvl")
        yield {"id": s.get(W + "styleId"), "name": _val(s.find(W + "name"), ""), "based_on": _val(s.find(W + "basedOn")), "outline": None if outline is None else _int(_val(outline), 9), "num_id": num_id, "ilvl": ilvl}


def _nums(root) -> Iterator[dict]:
    if root is None:
        return
    abstract = {a.get(W + "abstractNumId"): [(_int(lv.get(W + "ilvl"), 0), _val(lv.find(W + "numFmt"), "bullet")) for lv in a.iter(W + "lvl")] for a in root.iter(W + "abstractNum")}
    for num in root.iter(W + "num"):
        for ilvl, fmt in abstract.get(_val(num.find(W + "abstractNumId")), []):
            yield {"num_id": num.get(W + "numId"), "ilvl": ilvl, "fmt": fmt}


def _rels(root) -> Iterator[dict]:
    for r in () if root is None else root.iter("{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"):
        target = r.get("Target", "")
        yield {"id": r.get("Id"), "target": target, "external": target.startswith(("http:", "https:"))}


def _paras(body, notes) -> Iterator[dict]:
    """Paragraphs in document order; block numbers tell which stand in one table."""
    ord_, block = 0, -1

    def para(p, **where):
        nonlocal ord_
        ppr = p.find(W + "pPr")
        num_id, ilvl = _num_pr(ppr)
        row = {"place": "body", "row": None, "cell": None, "span": None, "note": None} | where
        row |= {"ord": ord_, "style": _val(None if ppr is None else ppr.find(W + "pStyle")), "num_id": num_id, "ilvl": ilvl, "runs": list(_runs(p))}
        ord_ += 1
        return row

    def blocks(parent):
        nonlocal block
        for el in parent:
            if el.tag == W + "p":
                block += 1
                yield para(el, block=block)
            elif el.tag == W + "tbl":
                block += 1
                for i, tr in enumerate(el.findall(W + "tr")):
                    for j, tc in enumerate(tr.findall(W + "tc")):
                        span = _int(_val(tc.find(f"{W}tcPr/{W}gridSpan")), 1)
                        ps = list(tc.iter(W + "p")) or [ET.Element(W + "p")]
                        for p in ps:
                            yield para(p, block=block, place="cell", row=i, cell=j, span=span)
            elif el.tag == W + "sdt":
                gallery = el.find(f"{W}sdtPr/{W}docPartObj/{W}docPartGallery")
                content = el.find(W + "sdtContent")
                if "Table of Contents" not in (_val(gallery, "") or "") and content is not None:
                    yield from blocks(content)

    yield from blocks(body)
    for fn in () if notes is None else notes.iter(W + "footnote"):
        for p in fn.iter(W + "p"):
            yield para(p, block=-1, place="note", note=fn.get(W + "id"))


def _on(props, tag: str) -> bool:
    el = None if props is None else props.find(W + tag)
    return el is not None and el.get(W + "val", "true").lower() not in ("0", "false", "off", "none")


def _runs(parent, link: str | None = None, link_no: int | None = None) -> Iterator[dict]:
    """Typed pieces; what stands in one hyperlink shares a number."""
    make = lambda kind, text="", fmt="", **more: {"kind": kind, "text": text, "fmt": fmt, "link": link, "link_no": link_no, "note": None, "alt": None} | more
    for n, el in enumerate(parent):
        if el.tag == W + "hyperlink":
            yield from _runs(el, el.get(R + "id", ""), n)
        elif el.tag in (W + "ins", W + "smartTag", W + "fldSimple", W + "customXml"):
            yield from _runs(el, link, link_no)
        elif el.tag == W + "sdt":
            content = el.find(W + "sdtContent")
            if content is not None:
                yield from _runs(content, link, link_no)
        elif el.tag == W + "r":
            props = el.find(W + "rPr")
            fmt = {(True, True): "***", (True, False): "**", (False, True): "*", (False, False): ""}[_on(props, "b"), _on(props, "i")]
            for c in el:
                if c.tag == W + "t":
                    yield make("text", c.text or "", fmt)
                elif c.tag == W + "tab":
                    yield make("tab", " ", fmt)
                elif c.tag in (W + "br", W + "cr"):
                    yield make("break")
                elif c.tag == W + "footnoteReference":
                    yield make("note", note=c.get(W + "id"))
                elif c.tag == W + "drawing":
                    blip, about = c.find(f".//{A}blip"), c.find(f".//{WP}docPr")
                    alt = "" if about is None else about.get("descr") or about.get("title") or ""
                    if blip is not None:
                        yield make("image", blip.get(R + "embed", ""), alt=alt.replace("\n", " "))
                    elif c.find(".//{*}chart") is not None:
                        yield make("chart")
                elif c.tag == W + "pict":
                    img = c.find(f".//{V}imagedata")
                    if img is not None:
                        yield make("image", img.get(R + "id", ""), alt="")
