"""EPUB packages: read, written, checked."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Collection, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirelight.operators import packages, render
from quirelight.operators.books import detect_chapters
from quirelight.sources import epub_io
from quirelight.sources.html import html_blocks, nav_links
from quirelight.sources.store import saved

MIMETYPE = "application/epub+zip"
CONTAINER = (
    '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>'
    '<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
)


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _all(root: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in root.iter() if _local(x) == name)


#: What each part of a package is read for. Members that no wanted part needs are never unpacked.
METADATA = ("title", "author", "language", "identifier", "manifest", "spine", "warnings")
MEMBERS = ("toc", "texts", "images")


def parse(content: BinaryIO, wanted: Collection[str] = (*METADATA, *MEMBERS)) -> dict:
    """A package's wanted parts, of a file that can seek: title, author, language, identifier; manifest [(pos, id, name,
    type)]; spine [(pos, idref)]; toc [(source, pos, href, title)]; texts [(name, markup)]; images
    [(asset_key, pos, media_type, content, cover)]; warnings."""
    out: dict = {"title": "Untitled", "author": "Unknown", "language": "und", "identifier": None, "manifest": [], "spine": [], "toc": [], "texts": [], "images": [], "warnings": []}
    with zipfile.ZipFile(content) as package:
        container = ElementTree.fromstring(package.read("META-INF/container.xml"))
        opf_path = next(_all(container, "rootfile")).attrib["full-path"]
        opf = ElementTree.fromstring(package.read(opf_path))
        for field, tag in (("title", "title"), ("author", "creator"), ("language", "language"), ("identifier", "identifier")):
            found = next((x.text.strip() for x in _all(opf, tag) if x.text and x.text.strip()), None)
            out[field] = found or out[field]
        items = [(i, x.attrib, unquote(x.attrib.get("href", "")), x.attrib.get("media-type", "")) for i, x in enumerate(_all(opf, "item"))]
        out["manifest"] = [(i, x.get("id", ""), name, kind) for i, x, name, kind in items]
        spine = next(_all(opf, "spine"), None)
        out["spine"] = [(i, x.attrib.get("idref", "")) for i, x in enumerate(_all(spine, "itemref"))] if spine is not None else []
        read = lambda name: package.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf_path), name)))
        links: list[tuple[str, str]] = []
        for _, x, name, kind in items:
            try:
                own = "nav" in x.get("properties", "").split() and "toc" in wanted
                if kind in packages.DOCUMENTS and ("texts" in wanted or own):
                    markup = read(name).decode("utf-8")
                    out["texts"].append((name, markup))
                    links += nav_links(markup) if own else []
                elif kind == "application/x-dtbncx+xml" and "toc" in wanted:
                    for n, point in enumerate(_all(ElementTree.fromstring(read(name)), "navPoint")):
                        label, target = next(_all(point, "text"), None), next(_all(point, "content"), None)
                        if label is not None and target is not None:
                            out["toc"].append((0, n, target.attrib.get("src", ""), (label.text or "").strip()))
            except (KeyError, UnicodeDecodeError, ElementTree.ParseError) as e:
                out["warnings"].append(f"{name}: {e}")
        out["toc"] += [(1, n, href, text) for n, (href, text) in enumerate(links)]
        if "images" in wanted:
            named = {m.attrib.get("content") for m in _all(opf, "meta") if m.attrib.get("name") == "cover"}
            out["images"] = _images(items, named, set(package.namelist()), posixpath.dirname(opf_path), package)
    return {k: out[k] for k in wanted}


def _images(items: list[tuple], named: set, members: set, folder: str, package: zipfile.ZipFile) -> list[tuple]:
    """The images in the manifest's order, each once. The cover is the one that the package names, else the
    first whose id or name says so. An image that the package lacks is left out."""
    out: dict[str, tuple] = {}
    marks = []
    for i, x, name, kind in items:
        path = posixpath.normpath(posixpath.join(folder, name))
        if kind.startswith("image/") and path in members and name not in out:
            says = "cover" in x.get("id", "").lower() or "cover" in posixpath.basename(name).lower()
            marks.append(0 if "cover-image" in x.get("properties", "").split() or x.get("id", "") in named else 1 if says else 2)
            out[name] = (name, i, kind, package.read(path))
    cover = marks.index(min(marks)) if marks and min(marks) < 2 else None
    return [(*row, i == cover) for i, row in enumerate(out.values())]


#: What reading a damaged package may raise.
BROKEN = (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError, TypeError, RuntimeError, ValueError)


def tolerant(content: BinaryIO | None, wanted: Collection[str]) -> dict:
    """:func:`parse`; of a package that can't be read, its fault as a warning and nothing else."""
    try:
        return parse(content, wanted)
    except BROKEN as e:
        empty = {k: [] if k in ("manifest", "spine", *MEMBERS) else None for k in wanted}
        return {**empty, "warnings": [str(e)]} if "warnings" in wanted else empty


PARTS = {
    "title": "string", "author": "string", "language": "string", "identifier": "string", "manifest": "array<struct<pos:int,id:string,name:string,type:string>>",
    "spine": "array<struct<pos:int,idref:string>>", "toc": "array<struct<source:int,pos:int,href:string,title:string>>", "texts": "array<struct<name:string,markup:string>>",
    "images": "array<struct<asset_key:string,pos:int,media_type:string,content:binary,cover:boolean>>", "warnings": "array<string>",
}


def parsed(files: DataFrame, wanted: Collection[str] = (*METADATA, "toc", "texts")) -> DataFrame:
    """files: book_id, content. The wanted parts of each package; null for its metadata where it can't be read."""
    schema = StructType([files.schema["book_id"], *StructType.fromDDL(", ".join(f"{c} {PARTS[c]}" for c in wanted))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                content = batch.column(1)[i].as_py()
                yield as_batch([{"book_id": batch.column(0)[i].as_py(), **tolerant(content and io.BytesIO(content), wanted)}], arrow)

    return files.select("book_id", "content").mapInArrow(run, schema)


def as_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Rows whose structs are tuples."""

    def fitted(value, kind: pa.DataType):
        if value is None or not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
            return value
        names = [kind.value_type.field(i).name for i in range(kind.value_type.num_fields)]
        return [dict(zip(names, x, strict=True)) for x in value]

    return pa.record_batch([pa.array([fitted(r[f.name], f.type) for r in rows], f.type) for f in schema], schema=schema)


def read_images(files: DataFrame) -> DataFrame:
    """files: book_id, content. A row for each image (see :func:`images_of`); none of what can't be read."""
    return images_of(parsed(files, ["images"]))


def images_of(parts: DataFrame) -> DataFrame:
    """(book_id, asset_key, pos, media_type, content, cover) of packages' images."""
    return parts.select("book_id", F.explode("images").alias("i")).select("book_id", "i.*")


def read_epubs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: book_id, content (as ``binaryFile`` reads it). See :func:`books_of`."""
    return books_of(saved(parsed(files), "epub-parts"))


def books_of(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, blocks) of packages' parts: blocks in reading order with their chapters, which headings and the contents'
    labels begin; in a book without any, the spine's documents that the contents name."""
    books = parts.select("book_id", "title", "author", "language", "identifier", "warnings")
    manifest = parts.select("book_id", F.explode("manifest").alias("m")).select("book_id", F.col("m.pos").alias("item_pos"), F.col("m.id").alias("item_id"), "m.name", F.col("m.type").alias("media_type"))
    spine = parts.select("book_id", F.explode("spine").alias("s")).select("book_id", "s.*")
    toc = parts.select("book_id", F.explode("toc").alias("t")).select("book_id", "t.*")
    texts = parts.select("book_id", F.explode("texts").alias("t")).select("book_id", "t.*")
    listed = packages.spine_documents(spine, manifest)
    documents = listed.join(texts, ["book_id", "name"]).withColumn("doc", F.to_json(F.struct("book_id", "pos")))
    found = html_blocks(documents, "doc", "markup").join(documents.select("doc", "book_id", "pos"), "doc")
    order = Window.partitionBy("book_id").orderBy("pos", "ord")
    flat = found.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).drop("doc", "ord")
    soft = packages.soft_boundaries(flat.select("book_id", "pos", "idx"), packages.document_titles(listed, packages.toc_titles(toc)))
    return books, detect_chapters(flat.drop("pos"), packages.toc_labels(toc), soft=soft)


def package(title: str, author: str, language: str, identifier: str, chapters: list[tuple[str, str]], layout: str = "horizontal", mode: str = "standard", images: dict[str, bytes] | None = None, cover: str | None = None) -> bytes:
    """A package's bytes. chapters: (title, body markup); without any, one empty page. images by
    file name; cover names one of them."""
    chapters = chapters or [(title, "<p></p>")]
    names = [f"chap_{i:04d}.xhtml" for i in range(len(chapters))]
    page = lambda head, body: (
        f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(head)}</title>'
        f'<link rel="stylesheet" href="style.css"/></head><body>{body}</body></html>'
    )
    items = [f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names)]
    types = {k: render.MEDIA_TYPES.get(k.rpartition(".")[2].lower(), "application/octet-stream") for k in images or {}}
    marked = lambda k: ' properties="cover-image"' if k == cover else ""
    items += [f'<item id="im{i}" href={quoteattr(quote(k))} media-type="{t}"{marked(k)}/>' for i, (k, t) in enumerate(types.items())]
    items += ['<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', '<item id="css" href="style.css" media-type="text/css"/>']
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
    direction = ' page-progression-direction="rtl"' if layout == "vertical" else ""
    opf = (
        '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title>'
        f'<dc:language>{escape(language)}</dc:language><dc:creator>{escape(author)}</dc:creator></metadata>'
        f'<manifest>{"".join(items)}</manifest><spine{direction}>{spine}</spine></package>'
    )
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    nav = page("Contents", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{links}</ol></nav>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        files = [("META-INF/container.xml", CONTAINER), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/style.css", render.css(layout, mode))]
        files += [(f"OEBPS/{n}", page(t, body)) for n, (t, body) in zip(names, chapters, strict=True)]
        files += [(f"OEBPS/{k}", data) for k, data in (images or {}).items()]
        stamp = (1980, 1, 1, 0, 0, 0)  # the same input gives the same bytes
        z.writestr(zipfile.ZipInfo("mimetype", stamp), MIMETYPE, zipfile.ZIP_STORED)
        for name, data in files:
            z.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def write_epubs(books: DataFrame, chapters: DataFrame, images: DataFrame | None = None, mode: str = "standard") -> DataFrame:
    """books: book_id, title, author, language and perhaps layout; chapters: book_id, ord, title, html;
    images: book_id, asset_key (the file's name), content, cover. (book_id, content) for each book,
    those without chapters too. One task holds one book at a time."""
    each = F.array_sort(F.collect_list(F.struct("ord", "title", "html")))
    rows = books.join(chapters.groupBy("book_id").agg(each.alias("chapters")), "book_id", "left")
    if images is not None:
        pictures = F.collect_list(F.struct("asset_key", "content", "cover")).alias("images")
        rows = rows.join(images.groupBy("book_id").agg(pictures), "book_id", "left")
    rows = rows if "layout" in rows.columns else rows.withColumn("layout", F.lit("horizontal"))
    kind = books.schema["book_id"].dataType.simpleString()

    def made(b: dict) -> bytes:
        own = sorted(b.get("images") or [], key=lambda x: x["asset_key"])
        cover = next((x["asset_key"] for x in own if x["cover"]), None)
        pages = [(c["title"], c["html"]) for c in b["chapters"] or []]
        return package(b["title"], b["author"], b["language"], f"urn:book:{b['book_id']}", pages, b["layout"] or "horizontal", mode, {x["asset_key"]: x["content"] for x in own}, cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([made(b) for b in batch.to_pylist()], pa.binary())], ["book_id", "content"])

    wanted = ["book_id", "title", "author", "language", "layout", "chapters", *(["images"] if images is not None else [])]
    return rows.select(*wanted).mapInArrow(run, f"book_id {kind}, content binary")


def save_files(packages_of: DataFrame, folder: str) -> None:
    """Each book's content as folder/<book_id>.epub, all of them or none: see :class:`~quirelight.sources.epub_io.Epub`."""
    epub_io.register(packages_of.sparkSession)
    packages_of.select(F.col("book_id").cast("string").alias("book_id"), "content").write.format("epub").mode("append").save(folder)


def problems(content: bytes | None) -> list[tuple[str, str]]:
    """(severity, code) of what is wrong with a package."""
    if not content:
        return [("error", "empty")]
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            out = []
            if "mimetype" not in names:
                out.append(("error", "no_mimetype"))
            elif z.read("mimetype").decode("utf-8", "replace").strip() != MIMETYPE:
                out.append(("error", "wrong_mimetype"))
            if "META-INF/container.xml" not in names:
                out.append(("error", "no_container"))
            if not any(n.endswith(".opf") for n in names):
                out.append(("error", "no_opf"))
            if not any(n.endswith((".xhtml", ".html", ".htm")) for n in names):
                out.append(("warning", "no_documents"))
            return out
    except zipfile.BadZipFile:
        return [("error", "no_zip")]


def package_findings(files: DataFrame) -> DataFrame:
    """files: book_id, content. (entity, severity, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(str(b), *p) for b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True) for p in problems(c)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], ["entity", "severity", "code"])

    return files.select("book_id", "content").mapInArrow(run, "entity string, severity string, code string")
