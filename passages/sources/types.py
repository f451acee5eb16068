"""Type identifiers of inputs: by extension, by loader, and the file type that results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Uniform type identifiers of the supported formats.
TEXT = ("public.plain-text", "public.text", "public.utf8-plain-text")
PDF = ("com.adobe.pdf",)
MARKDOWN = ("net.daringfireball.markdown", "public.markdown", "public.md")
DOCX = ("org.openxmlformats.wordprocessingml.document",)
HTML = ("public.html",)
RTF = ("public.rtf",)
CSV = ("public.comma-separated-values-text",)
TSV = ("public.tab-separated-values-text",)
JSON = ("public.json",)
XML = ("public.xml",)
YAML = ("public.yaml",)
IMAGE = ("public.image", "public.png", "public.jpeg", "public.heic", "public.heif", "public.tiff", "com.compuserve.gif", "org.webmproject.webp")

EXTENSIONS = {
    "pdf": PDF[0], "md": MARKDOWN[0], "markdown": MARKDOWN[0], "docx": DOCX[0], "html": HTML[0], "htm": HTML[0], "rtf": RTF[0],
    "csv": CSV[0], "tsv": TSV[0], "json": JSON[0], "xml": XML[0], "yaml": YAML[0], "yml": YAML[0], "png": "public.png",
    "jpg": "public.jpeg", "jpeg": "public.jpeg", "heic": "public.heic", "tif": "public.tiff", "tiff": "public.tiff", "gif": "com.compuserve.gif",
    "webp": "org.webmproject.webp", "txt": TEXT[0], "log": TEXT[0],
}

#: Loaders in the order they are asked.
LOADERS = (("pdf", PDF), ("markdown", MARKDOWN), ("docx", DOCX), ("html", HTML), ("rtf", RTF), ("csv", CSV), ("tsv", TSV), ("json", JSON), ("xml", XML), ("yaml", YAML), ("image", IMAGE), ("text", TEXT))


def _looked_up(value: Column, pairs: dict[str, str]) -> Column:
    """The pair's value, null for others; a map literal, so the value is computed once."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), value)


def uti_of(path: Column) -> Column:
    """The identifier that a path's extension stands for; unknown ones are plain text."""
    return F.coalesce(_looked_up(F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)), EXTENSIONS), F.lit(TEXT[0]))


def loader_of(uti: Column) -> Column:
    """The loader of an identifier, null if none takes it."""
    return _looked_up(uti, {u: name for name, utis in reversed(LOADERS) for u in utis})


def file_type(uti: Column) -> Column:
    """pdf, text, markdown, docx, image, or the identifier's last part."""
    named = {u: name for name, utis in (("pdf", PDF), ("text", TEXT), ("markdown", MARKDOWN), ("docx", DOCX), ("image", IMAGE)) for u in utis}
    return F.coalesce(_looked_up(uti, named), F.element_at(F.split(uti, r"\."), -1))
