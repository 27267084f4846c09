"""Media types, extensions and kinds of files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTETS = "application/octet-stream"
_OFFICE, _OPEN = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument."

# type -> its extensions; the first is the one that a bare name gets, unless _ORDER says otherwise
_BY_TYPE = {
    "audio": "aac=aac flac=flac mp4=m4a mpeg=mp3 ogg=ogg,oga opus=opus wav=wav webm=weba",
    "font": "otf=otf ttf=ttf woff=woff woff2=woff2",
    "image": "avif=avif bmp=bmp gif=gif heic=heic heif=heif jpeg=jpg,jpeg png=png svg+xml=svg tiff=tif,tiff webp=webp x-icon=ico",
    "video": "mp4=mp4,m4v mpeg=mpeg,mpg ogg=ogv quicktime=mov webm=webm x-matroska=mkv x-msvideo=avi",
    "text": "css=css csv=csv html=html,htm javascript=js,mjs,cjs jsx=jsx markdown=md,markdown plain=txt tab-separated-values=tsv tsx=tsx typescript=ts "
    "x-c=c,h x-c++=cpp,hpp x-csharp=cs x-go=go x-java=java x-kotlin=kt x-php=php x-python=py x-ruby=rb x-rust=rs x-shellscript=sh x-sql=sql x-swift=swift",
    "application": "json=json,jsonc toml=toml xml=xml yaml=yaml,yml",
}
_BY_KIND = {
    "archive": {"application/gzip": "gz,tgz", "application/vnd.rar": "rar", "application/x-7z-compressed": "7z", "application/x-bzip2": "bz2", "application/x-tar": "tar", "application/x-xz": "xz", "application/zip": "zip"},
    "document": {"application/epub+zip": "epub", "application/msword": "doc", "application/pdf": "pdf", "application/rtf": "rtf", "application/vnd.apple.pages": "pages", f"{_OFFICE}wordprocessingml.document": "docx", f"{_OPEN}text": "odt"},
    "presentation": {"application/vnd.apple.keynote": "key", "application/vnd.ms-powerpoint": "ppt", f"{_OFFICE}presentationml.presentation": "pptx", f"{_OPEN}presentation": "odp"},
    "spreadsheet": {"application/vnd.apple.numbers": "numbers", "application/vnd.ms-excel": "xls", f"{_OFFICE}spreadsheetml.sheet": "xlsx", f"{_OPEN}spreadsheet": "ods"},
}
EXTENSIONS: dict[str, str] = {}
PREFERRED: dict[str, str] = {}
for _top, _listed in _BY_TYPE.items():
    for _pair in _listed.split():
        _sub, _, _own = _pair.rpartition("=")
        for _e in _own.split(","):
            EXTENSIONS[_e] = f"{_top}/{_sub}"
            PREFERRED.setdefault(f"{_top}/{_sub}", _e)
KINDS: dict[str, str] = {}
for _kind, _types in _BY_KIND.items():
    for _type, _own in _types.items():
        KINDS[_type] = _kind
        for _e in _own.split(","):
            EXTENSIONS[_e] = _type
            PREFERRED.setdefault(_type, _e)
TOP_KINDS = frozenset(("audio", "font", "image", "video"))
# a type counts as code wherever one of these stands in it
_CODE = "javascript|typescript|json|xml|yaml|toml|x-(?:shellscript|python|ruby|go|rust|java|kotlin|c|php|swift|sql)"
_TEXT_LIKE = frozenset(f"application/{x}" for x in ("json", "toml", "x-ndjson", "xml", "yaml"))


def base_name(path: str) -> str:
    return re.split(r"[/\\]", path.rstrip("/\\"))[-1]


def extension_of(name: str) -> str:
    """Lower-case extension; none for a leading or a last dot."""
    stem, dot, end = base_name(name).rpartition(".")
    return end.lower() if dot and stem and end else ""


def mime_from_name(name: str) -> str:
    return EXTENSIONS.get(extension_of(name), OCTETS)


def normalize_mime(mime: str) -> str:
    return mime.partition(";")[0].strip().lower()


def extension_from_mime(mime: str) -> str:
    return PREFERRED.get(normalize_mime(mime), "")


def with_extension(name: str, mime: str) -> str:
    more = "" if extension_of(name) else extension_from_mime(mime)
    return f"{name}.{more}" if more else name


def kind_from_mime(mime: str) -> str:
    mime = normalize_mime(mime)
    top = mime.partition("/")[0]
    if top in TOP_KINDS:
        return top
    if mime in KINDS:
        return KINDS[mime]
    if top in ("text", "application") and re.search(_CODE, mime):
        return "code"
    return "text" if top == "text" else "other"


def is_text_like(mime: str) -> bool:
    mime = normalize_mime(mime)
    return mime.startswith("text/") or mime in _TEXT_LIKE or mime.endswith(("+json", "+xml"))


def strip_control(text: str) -> str:
    return re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ", text)


def text_preview(data: bytes, mime: str, most: int) -> str:
    """The text of the first bytes of a payload of a text-like type."""
    return strip_control(data[:most].decode("utf-8", "replace")) if most > 0 and is_text_like(mime) else ""


# --- columns ---


def _lookup(key: Column, of: dict[str, str]) -> Column:
    """The entry of a key, null where there is none; one call to the JVM for all entries."""
    entries = ", ".join(f"'{k}', '{v}'" for k, v in of.items())  # constants without quotes
    return F.try_element_at(F.expr(f"map({entries})"), key)


def extension_column(name: Column) -> Column:
    base = F.regexp_extract(F.regexp_replace(name, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^[\s\S]+\.([^.]+)$", 1))


def normalize_mime_column(mime: Column) -> Column:
    return F.lower(F.trim(F.substring_index(mime, ";", 1)))


def mime_column(name: Column) -> Column:
    return F.coalesce(_lookup(extension_column(name), EXTENSIONS), F.lit(OCTETS))


def kind_column(mime: Column) -> Column:
    mime = normalize_mime_column(mime)
    top = F.substring_index(mime, "/", 1)
    return (
        F.when(top.isin(*sorted(TOP_KINDS)), top)
        .when(_lookup(mime, KINDS).isNotNull(), _lookup(mime, KINDS))
        .when(top.isin("text", "application") & mime.rlike(_CODE), "code")
        .when(top == "text", "text")
        .otherwise("other")
    )


def text_like_column(mime: Column) -> Column:
    mime = normalize_mime_column(mime)
    return mime.startswith("text/") | mime.isin(*sorted(_TEXT_LIKE)) | mime.endswith("+json") | mime.endswith("+xml")


def with_extension_column(name: Column, mime: Column) -> Column:
    more = F.coalesce(_lookup(normalize_mime_column(mime), PREFERRED), F.lit(""))
    return F.when((extension_column(name) == "") & (more != ""), F.concat_ws(".", name, more)).otherwise(name)


def text_preview_column(data: Column, mime: Column, most: int) -> Column:
    text = F.regexp_replace(F.decode(F.substring(data, 1, most), "UTF-8"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " ")
    return F.when(text_like_column(mime) & F.lit(most > 0), text).otherwise("")
