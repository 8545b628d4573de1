"""Extension -> MIME lookup (U5, used by R4 and F1).

The lookup takes the lowercased, trimmed path, keeps the text after the last
``.`` (the whole string when there is no dot) and looks it up; unknown gives
null. The table is a literal map expression, so the lookup is evaluated inside
generated code with no join.
"""

from __future__ import annotations

import mimetypes
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MIME = "application/octet-stream"

# Common extension -> MIME type pairs of the public mime-db
# registry (IANA types preferred), as the path-based lookup reports them.
EXTENSION_MIME = {
    "html": "text/html",
    "htm": "text/html",
    "shtml": "text/html",
    "xhtml": "application/xhtml+xml",
    "xht": "application/xhtml+xml",
    "css": "text/css",
    "js": "text/javascript",
    "mjs": "text/javascript",
    "json": "application/json",
    "map": "application/json",
    "jsonld": "application/ld+json",
    "webmanifest": "application/manifest+json",
    "xml": "application/xml",
    "xsl": "application/xml",
    "rss": "application/rss+xml",
    "atom": "application/atom+xml",
    "txt": "text/plain",
    "text": "text/plain",
    "log": "text/plain",
    "ini": "text/plain",
    "csv": "text/csv",
    "tsv": "text/tab-separated-values",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "ics": "text/calendar",
    "vcf": "text/vcard",
    "yaml": "text/yaml",
    "yml": "text/yaml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "jpe": "image/jpeg",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "svgz": "image/svg+xml",
    "webp": "image/webp",
    "avif": "image/avif",
    "bmp": "image/bmp",
    "ico": "image/vnd.microsoft.icon",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "apng": "image/apng",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "eot": "application/vnd.ms-fontobject",
    "pdf": "application/pdf",
    "zip": "application/zip",
    "gz": "application/gzip",
    "tar": "application/x-tar",
    "7z": "application/x-7z-compressed",
    "rtf": "application/rtf",
    "epub": "application/epub+zip",
    "wasm": "application/wasm",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "odt": "application/vnd.oasis.opendocument.text",
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "ogg": "audio/ogg",
    "oga": "audio/ogg",
    "wav": "audio/wav",
    "weba": "audio/webm",
    "flac": "audio/flac",
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "webm": "video/webm",
    "ogv": "video/ogg",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mpeg": "video/mpeg",
    "mpg": "video/mpeg",
    "3gp": "video/3gpp",
    "mkv": "video/x-matroska",
    "flv": "video/x-flv",
    "wmv": "video/x-ms-wmv",
    "mid": "audio/midi",
    "midi": "audio/midi",
    "opus": "audio/ogg",
    "heic": "image/heic",
    "jxl": "image/jxl",
    "psd": "image/vnd.adobe.photoshop",
    "djvu": "image/vnd.djvu",
    "jar": "application/java-archive",
    "swf": "application/x-shockwave-flash",
    "ps": "application/postscript",
    "eps": "application/postscript",
    "ai": "application/postscript",
    "bz2": "application/x-bzip2",
    "xz": "application/x-xz",
    "apk": "application/vnd.android.package-archive",
    "dmg": "application/x-apple-diskimage",
    "iso": "application/x-iso9660-image",
    "sh": "application/x-sh",
    "csh": "application/x-csh",
    "tex": "application/x-tex",
    "pl": "application/x-perl",
    "sql": "application/sql",
    "toml": "application/toml",
    "gpx": "application/gpx+xml",
    "kml": "application/vnd.google-earth.kml+xml",
    "kmz": "application/vnd.google-earth.kmz",
    "srt": "application/x-subrip",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation",
    "vtt": "text/vtt",
    "java": "text/x-java-source",
    "c": "text/x-c",
    "h": "text/x-c",
    "cpp": "text/x-c",
}


def load_registry(path: str | None = None) -> None:
    """Add the types of the standard library's registry and of a registry file (``mime.types`` format: a type and its
    extensions a line; by default the one ``SITELENS_MIME_TYPES`` names). The pairs above and earlier ones are kept.
    A deployment that has the full public registry as such a file gets it by naming it; on the driver only."""
    found = {k.lstrip("."): v for k, v in sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())}
    path = path or os.environ.get("SITELENS_MIME_TYPES")
    if path:
        with open(path, encoding="utf-8") as f:
            for line in f:
                kind, *exts = line.split("#", 1)[0].split() or [""]
                found |= {e.lower(): kind for e in exts if e.lower() not in found}
    for ext, kind in found.items():
        EXTENSION_MIME.setdefault(ext, kind)


load_registry()


def _map_literal() -> Column:
    # one SQL map literal: a single call to build, instead of two per entry
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in EXTENSION_MIME.items())
    return F.expr(f"map({pairs})")


def extension_key(path: Column) -> Column:
    p = F.lower(F.trim(path))
    return F.when(F.instr(p, ".") == 0, p).otherwise(F.substring_index(p, ".", -1))


def mime_for_path(path: Column) -> Column:
    """MIME type for a path by extension, null if unknown."""
    return F.try_element_at(_map_literal(), extension_key(path))


def oracle_values_sql() -> str:
    """The table as a SQL VALUES list (for the DuckDB oracles)."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in EXTENSION_MIME.items())
    return f"(values {rows}) as mime_ext(ext, mime)"
