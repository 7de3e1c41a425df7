"""PowerPoint packages as rows: one row per document with its slides, shapes, placeholders of
layouts and masters, and list styles as arrays. Inheritance is left to operators/slides.py."""

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

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
DGM = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
SKIPPED = ("sldNum", "ftr", "dt", "hdr")

LEVEL = "struct<lvl:int,marker:string,decided:boolean,margin:int>"
PARA = "struct<lvl:int,marker:string,decided:boolean,margin:int,runs:array<struct<text:string,fmt:string,url:string,brk:boolean>>>"
POINT = "struct<series:int,name:string,idx:int,category:string,value:string>"
SCHEMA = (
    "doc_id string, error string, core string, height bigint, "
    "slides array<struct<slide_no:int,part:string,hidden:boolean,layout:string,master:string>>, "
    "shapes array<struct<slide_no:int,z:int,ancestors:array<int>,notes:boolean,kind:string,ph:boolean,ph_type:string,ph_idx:string,y:bigint,x:bigint,"
    f"paras array<{PARA}>,levels array<{LEVEL}>,image:string,alt:string,cells array<array<array<struct<text:string,fmt:string,url:string,brk:boolean>>>>,"
    f"title:string,points array<{POINT}>,texts array<string>>>, "
    f"holders array<struct<part:string,seq:int,idx:string,type:string,y:bigint,x:bigint,levels:array<{LEVEL}>>>, "
    f"body_styles array<struct<master:string,levels:array<{LEVEL}>>>, "
    "media array<struct<part:string,bytes:binary>>"
).replace("paras array", "paras:array").replace("levels array", "levels:array").replace("cells array", "cells:array").replace("points array", "points:array").replace("texts array", "texts:array")


def read_packages(files: DataFrame) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([_package(doc_id.as_py(), content.as_py())], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, SCHEMA)


def _package(doc_id: str, data: bytes) -> dict:
    out: dict = {"doc_id": doc_id, "error": None, "core": None, "height": 6858000, "slides": [], "shapes": [], "holders": [], "body_styles": [], "media": []}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            _Deck(z, out).read()
    except Exception as e:  # noqa: BLE001 -- a broken file is a row with its error
        out |= {"error": f"{type(e).__name__}: {e}", "slides": [], "shapes": []}
    return out


def _own(ppr) -> tuple[str | None, bool]:
    """What paragraph properties say of a list mark, and whether they say anything."""
    for tag, marker in (("buNone", None), ("buAutoNum", "1."), ("buChar", "-"), ("buBlip", "-")):
        if ppr is not None and ppr.find(A + tag) is not None:
            return marker, True
    return None, False


def _levels(style) -> list[dict]:
    out = []
    for n in range(9):
        el = None if style is None else style.find(f"{A}lvl{n + 1}pPr")
        if el is not None:
            marker, decided = _own(el)
            out.append({"lvl": n, "marker": marker, "decided": decided, "margin": None if el.get("marL") is None else int(el.get("marL"))})
    return out


class _Deck:
    def __init__(self, z: zipfile.ZipFile, out: dict):
        self.z, self.out, self.names = z, out, set(z.namelist())
        self.media: set[str] = set()

    def xml(self, part: str | None):
        return ET.fromstring(self.z.read(part)) if part in self.names else None

    def rels(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """id: (target part or address, last word of the type, external)"""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", name + ".rels"))
        out = {}
        for r in () if root is None else root.iter(REL):
            far = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            out[r.get("Id")] = (target if far else posixpath.normpath(posixpath.join(folder, target)).lstrip("/"), r.get("Type", "").rpartition("/")[2], far)
        return out

    def read(self) -> None:
        pres = self.xml("ppt/presentation.xml")
        size = pres.find(P + "sldSz")
        if size is not None:
            self.out["height"] = int(size.get("cy", "6858000"))
        if "docProps/core.xml" in self.names:
            self.out["core"] = self.z.read("docProps/core.xml").decode("utf-8", "replace")
        rels = self.rels("ppt/presentation.xml")
        parts = [rels[s.get(R + "id")][0] for s in pres.iterfind(f"{P}sldIdLst/{P}sldId") if s.get(R + "id") in rels]
        seen: set[str] = set()
        for no, part in enumerate(parts, 1):
            root, own = self.xml(part), self.rels(part)
            of = lambda table, kind: next((t for t, k, _ in table.values() if k == kind), None)
            layout = of(own, "slideLayout")
            master = of(self.rels(layout), "slideMaster") if layout else None
            self.out["slides"].append({"slide_no": no, "part": part, "hidden": root.get("show") == "0", "layout": layout, "master": master})
            for p in {layout, master} - seen - {None}:
                seen.add(p)
                self.holders(p, p == master)
            tree = root.find(f"{P}cSld/{P}spTree")
            if tree is not None:
                self.shapes(tree, own, no, [])
            notes = of(own, "notesSlide")
            notes_root = self.xml(notes)
            for sp in () if notes_root is None else notes_root.iter(P + "sp"):
                ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                if ph is not None and ph.get("type") == "body" and sp.find(P + "txBody") is not None:
                    self.add(no, [], "sp", notes=True, paras=self.paras(sp.find(P + "txBody"), self.rels(notes)))
        self.out["media"] = [{"part": p, "bytes": self.z.read(p)} for p in sorted(self.media)]

    def holders(self, part: str, master: bool) -> None:
        root = self.xml(part)
        for seq, sp in enumerate(() if root is None else root.iter(P + "sp")):
            ph = sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            if ph is not None:
                y, x = self.place(sp)
                self.out["holders"].append({"part": part, "seq": seq, "idx": ph.get("idx") or None, "type": ph.get("type", "body"), "y": y, "x": x, "levels": _levels(sp.find(f"{P}txBody/{A}lstStyle"))})
        if master and root is not None:
            self.out["body_styles"].append({"master": part, "levels": _levels(root.find(f"{P}txStyles/{P}bodyStyle"))})

    @staticmethod
    def place(el) -> tuple[int | None, int | None]:
        off = el.find(f"*/{A}xfrm/{A}off")
        off = el.find(f"{P}xfrm/{A}off") if off is None else off
        return (None, None) if off is None else (int(off.get("y", 0)), int(off.get("x", 0)))

    def add(self, no: int, ancestors: list[int], kind: str, **more) -> int:
        z = len(self.out["shapes"])
        empty = dict.fromkeys(("ph_type", "ph_idx", "y", "x", "image", "alt", "title"))
        self.out["shapes"].append(empty | {"slide_no": no, "z": z, "ancestors": ancestors, "notes": False, "kind": kind, "ph": False, "paras": [], "levels": [], "cells": [], "points": [], "texts": []} | more)
        return z

    def shapes(self, tree, rels, no: int, ancestors: list[int]) -> None:
        for el in tree:
            y, x = self.place(el)
            ph = el.find(f"*/{P}nvPr/{P}ph")
            where = {"y": y, "x": x, "ph": ph is not None, "ph_type": None if ph is None else ph.get("type", "body"), "ph_idx": None if ph is None else ph.get("idx") or None}
            if el.tag == P + "sp":
                body = el.find(P + "txBody")
                if where["ph_type"] not in SKIPPED and body is not None:
                    self.add(no, ancestors, "sp", paras=self.paras(body, rels), levels=_levels(body.find(A + "lstStyle")), **where)
            elif el.tag == P + "grpSp":
                self.shapes(el, rels, no, [*ancestors, self.add(no, ancestors, "group", **where)])
            elif el.tag == P + "pic":
                blip, about = el.find(f"{P}blipFill/{A}blip"), el.find(f"{P}nvPicPr/{P}cNvPr")
                target, _, far = rels.get("" if blip is None else blip.get(R + "embed", ""), (None, None, True))
                if not far and target in self.names:
                    self.media.add(target)
                    self.add(no, ancestors, "pic", image=target, alt="" if about is None else about.get("descr") or "", **where)
            elif el.tag == P + "graphicFrame":
                self.frame(el.find(f"{A}graphic/{A}graphicData"), rels, no, ancestors, where)

    def frame(self, data, rels, no, ancestors, where) -> None:
        if data is None:
            return
        tbl, chart, diagram = data.find(A + "tbl"), data.find(C + "chart"), data.find(DGM + "relIds")
        if tbl is not None:
            merged = lambda tc: tc.get("hMerge") == "1" or tc.get("vMerge") == "1"
            # A cell is its paragraphs' pieces; paragraphs end with a piece that holds a line feed.
            cell = lambda tc: [] if merged(tc) else [r for p in tc.iterfind(f"{A}txBody/{A}p") for r in [*self.runs(p, rels), {"text": "\n", "fmt": "", "url": None, "brk": False}]]
            self.add(no, ancestors, "tbl", cells=[[cell(tc) for tc in tr.findall(A + "tc")] for tr in tbl.findall(A + "tr")], **where)
        elif chart is not None and chart.get(R + "id") in rels:
            root = self.xml(rels[chart.get(R + "id")][0])
            if root is not None:
                self.add(no, ancestors, "chart", title=" ".join(t.text or "" for t in root.iterfind(f"{C}chart/{C}title//{A}t")).strip(), points=list(_points(root)), **where)
        elif diagram is not None and diagram.get(R + "dm") in rels:
            root = self.xml(rels[diagram.get(R + "dm")][0])
            texts = [] if root is None else [" ".join(t.text or "" for t in pt.iter(A + "t")).strip() for pt in root.iter(DGM + "pt")]
            self.add(no, ancestors, "smartart", texts=[t for t in texts if t], **where)
        else:
            self.add(no, ancestors, "other", **where)

    def paras(self, body, rels) -> list[dict]:
        out = []
        for p in body.findall(A + "p"):
            ppr = p.find(A + "pPr")
            marker, decided = _own(ppr)
            margin = None if ppr is None or ppr.get("marL") is None else int(ppr.get("marL"))
            out.append({"lvl": 0 if ppr is None else int(ppr.get("lvl", "0")), "marker": marker, "decided": decided, "margin": margin, "runs": list(self.runs(p, rels))})
        return out

    @staticmethod
    def runs(p, rels) -> Iterator[dict]:
        for el in p:
            if el.tag in (A + "r", A + "fld"):
                t, props = el.find(A + "t"), el.find(A + "rPr")
                bold, italic = (props is not None and props.get(k) == "1" for k in "bi")
                link = None if props is None else props.find(A + "hlinkClick")
                target, _, far = rels.get("" if link is None else link.get(R + "id", ""), (None, None, False))
                yield {"text": "" if t is None else t.text or "", "fmt": {(1, 1): "***", (1, 0): "**", (0, 1): "*", (0, 0): ""}[bold, italic], "url": target if far else None, "brk": False}
            elif el.tag == A + "br":
                yield {"text": "", "fmt": "", "url": None, "brk": True}


def _points(root) -> Iterator[dict]:
    """Cached chart values, long: series, idx, category, value; a series without points has one
    row without idx."""
    def cached(el):
        return {} if el is None else {int(pt.get("idx", 0)): pt.findtext(C + "v", "") or "" for pt in el.iter(C + "pt")}

    categories: dict[int, str] = {}
    for n, ser in enumerate(root.iter(C + "ser")):
        name = " ".join(cached(ser.find(C + "tx")).values()) or None
        categories = categories or cached(ser.find(C + "cat")) or cached(ser.find(C + "xVal"))
        values = cached(ser.find(C + "val")) or cached(ser.find(C + "yVal"))
        yield {"series": n, "name": name, "idx": None, "category": None, "value": None}
        for i, v in values.items():
            yield {"series": n, "name": name, "idx": i, "category": None, "value": v}
    for i, c in categories.items():
        yield {"series": None, "name": None, "idx": i, "category": c, "value": None}
