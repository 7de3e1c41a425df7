"""Word and PowerPoint files built with the standard library."""

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(*rows) -> str:
    body = "".join(f'<Relationship Id="{i}" Type="{REL}/{kind}" Target="{target}"{" TargetMode=" + chr(34) + "External" + chr(34) if far else ""}/>' for i, kind, target, far in rows)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{body}</Relationships>'


def run(text, props=""):
    return f'<w:r><w:rPr>{props}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def para(content, style=None, num=None):
    ppr = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{ppr}</w:pPr>{content}</w:p>"


def note(i):
    return f'<w:r><w:footnoteReference w:id="{i}"/></w:r>'


def cell(*paras, span=1):
    return f'<w:tc><w:tcPr><w:gridSpan w:val="{span}"/></w:tcPr>{"".join(paras)}</w:tc>'


def docx() -> bytes:
    drawing = '<w:r><w:drawing><wp:docPr descr="a map"/><a:blip r:embed="rIm"/></w:drawing></w:r>'
    link = f'<w:hyperlink r:id="rLn">{run("site")}</w:hyperlink>'
    toc = '<w:sdt><w:sdtPr><w:docPartObj><w:docPartGallery w:val="Table of Contents"/></w:docPartObj></w:sdtPr><w:sdtContent>' + para(run("toc line")) + "</w:sdtContent></w:sdt>"
    table = "<w:tbl><w:tr>" + cell(para(run("wide")), span=2) + cell(para(run("c|d"))) + "</w:tr><w:tr>" + cell(para(run("x")), para(run("y"))) + cell(para("")) + cell(para(run("z"))) + "</w:tr></w:tbl>"
    body = (
        toc + para(run("Intro ") + run("bold", "<w:b/>") + run("er", "<w:b/>") + run(" and ") + run("it", "<w:i/>") + link + note(7))
        + para(run("Chapter ") + run("one", "<w:b/>"), "H1") + para(run("2024. Een jaar *ster*"))
        + para(f'<w:del>{run("gone")}</w:del><w:ins>{run("kept")}</w:ins>')
        + para(run("first"), num=(1, 0)) + para(run("nested"), num=(1, 1)) + para(run("second"), num=(1, 0)) + para(run("again"), num=(1, 1))
        + para(run("dot"), "LB") + para(run("deep"), "LB2")
        + para(run("Chapter two"), "H1b") + table + para(drawing) + para(run("see") + note(9) + note(7))
        + para(run("Chapter three"), "H1")
    )
    styles = (
        '<w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H1b"><w:name w:val="mine"/><w:basedOn w:val="H1"/></w:style>'
        '<w:style w:styleId="LB"><w:name w:val="List Bullet"/><w:pPr><w:numPr><w:numId w:val="2"/></w:numPr></w:pPr></w:style>'
        '<w:style w:styleId="LB2"><w:name w:val="List Bullet 2"/><w:basedOn w:val="LB"/></w:style>'
        '<w:style w:styleId="Loop"><w:name w:val="loop"/><w:basedOn w:val="Loop"/></w:style>'
    )
    numbering = (
        '<w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum>'
        '<w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>'
        '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    )
    notes = f'<w:footnote w:id="7">{para(run("seven"))}</w:footnote><w:footnote w:id="9">{para(run("nine"))}</w:footnote>'
    core = '<cp:coreProperties xmlns:cp="x" xmlns:dc="y" xmlns:dcterms="z"><dc:title>My &amp; title</dc:title><dc:creator>A. Writer</dc:creator></cp:coreProperties>'
    return package({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{styles}</w:styles>",
        "word/numbering.xml": f"<w:numbering {W}>{numbering}</w:numbering>", "word/footnotes.xml": f"<w:footnotes {W}>{notes}</w:footnotes>",
        "word/_rels/document.xml.rels": rels(("rIm", "image", "media/image1.PNG", False), ("rLn", "hyperlink", "https://example.org/", True)),
        "word/media/image1.PNG": b"png", "docProps/core.xml": core,
    })


def shape(paras, ph=None, at=None):
    pos = f'<a:xfrm><a:off x="{at[1]}" y="{at[0]}"/></a:xfrm>' if at else ""
    holder = f"<p:ph {ph}/>" if ph is not None else ""
    body = "".join(f'<a:p><a:pPr lvl="{lv}">{mark}</a:pPr><a:r><a:rPr/><a:t>{text}</a:t></a:r></a:p>' for lv, mark, text in paras)
    return f"<p:sp><p:nvSpPr><p:cNvPr/><p:nvPr>{holder}</p:nvPr></p:nvSpPr><p:spPr>{pos}</p:spPr><p:txBody><a:lstStyle/>{body}</p:txBody></p:sp>"


def slide(shapes, show=""):
    return f"<p:sld {P} {show}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"


def pptx() -> bytes:
    plain = lambda *texts: [(0, "", x) for x in texts]
    frame = lambda data, y: f'<p:graphicFrame><p:xfrm><a:off x="0" y="{y}"/></p:xfrm><a:graphic><a:graphicData>{data}</a:graphicData></a:graphic></p:graphicFrame>'
    tbl = "<a:tbl><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>" for x in ("h1", "h2")) + "</a:tr><a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{x}</a:t></a:r></a:p></a:txBody></a:tc>" for x in ("a|b", "c")) + "</a:tr></a:tbl>"
    pic = '<p:pic><p:nvPicPr><p:cNvPr descr="city map"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="rP"/></p:blipFill><p:spPr><a:xfrm><a:off x="0" y="5000000"/></a:xfrm></p:spPr></p:pic>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="3000000"/></a:xfrm></p:grpSpPr>{shape(plain("late"), at=(900000, 9))}{shape(plain("early"), at=(100, 9))}</p:grpSp>'
    first = slide(shape(plain("Deck title"), 'type="title"') + shape([(0, "", "one"), (1, "", "two"), (0, "", "three")], 'idx="1"'))
    second = slide(shape(plain("right"), at=(2000000, 5000000)) + shape(plain("left"), at=(2010000, 100)) + shape(plain("Box title"), at=(100, 100)) + group, 'show="0"')
    third = slide(frame(tbl, 100) + frame('<c:chart r:id="rC"/>', 2000000) + pic + frame("", 6000000))
    chart = f'<c:chartSpace {P}><c:chart><c:title><a:t>Sales</a:t></c:title><c:ser><c:cat><c:pt idx="0"><c:v>q1</c:v></c:pt><c:pt idx="1"><c:v>q2</c:v></c:pt></c:cat><c:val><c:pt idx="0"><c:v>5</c:v></c:pt></c:val></c:ser></c:chart></c:chartSpace>'
    bullets = "".join(f'<a:lvl{n}pPr marL="{n * 100}"><a:buChar char="x"/></a:lvl{n}pPr>' for n in (1, 2))
    master = f"<p:sldMaster {P}><p:cSld><p:spTree/></p:cSld><p:txStyles><p:bodyStyle>{bullets}</p:bodyStyle></p:txStyles></p:sldMaster>"
    layout = f'<p:sldLayout {P}><p:cSld><p:spTree>{shape([], "type=" + chr(34) + "title" + chr(34), at=(10, 10))}{shape([], "idx=" + chr(34) + "1" + chr(34), at=(1500000, 10))}</p:spTree></p:cSld></p:sldLayout>'
    notes = f"<p:notes {P}><p:cSld><p:spTree>{shape(plain('say this'), 'type=' + chr(34) + 'body' + chr(34))}</p:spTree></p:cSld></p:notes>"
    lay = ("rL", "slideLayout", "../slideLayouts/slideLayout1.xml", False)
    return package({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="1" r:id="r7"/><p:sldId id="2" r:id="r2"/><p:sldId id="3" r:id="r3"/></p:sldIdLst><p:sldSz cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r7", "slide", "slides/slide7.xml", False), ("r2", "slide", "slides/slide2.xml", False), ("r3", "slide", "slides/slide3.xml", False)),
        "ppt/slides/slide7.xml": first, "ppt/slides/slide2.xml": second, "ppt/slides/slide3.xml": third,
        "ppt/slides/_rels/slide7.xml.rels": rels(lay, ("rN", "notesSlide", "../notesSlides/notesSlide1.xml", False)), "ppt/slides/_rels/slide2.xml.rels": rels(lay),
        "ppt/slides/_rels/slide3.xml.rels": rels(lay, ("rC", "chart", "../charts/chart1.xml", False), ("rP", "image", "../media/i.png", False)),
        "ppt/slideLayouts/slideLayout1.xml": layout, "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("rM", "slideMaster", "../slideMasters/m.xml", False)),
        "ppt/slideMasters/m.xml": master, "ppt/notesSlides/notesSlide1.xml": notes, "ppt/charts/chart1.xml": chart, "ppt/media/i.png": b"img",
    })
