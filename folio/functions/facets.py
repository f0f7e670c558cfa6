"""What documents say of themselves: text strings, metadata packets, claims, files, layers, words and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD

# The bytes 0x18 to 0x1F and 0x80 to 0xA0 of the document encoding; the others are those of Latin-1.
LOW_BYTES = "˘ˇˆ˙˝˛˚˜"
HIGH_BYTES = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž�€"
# Extensions of files that run code, subtypes that form data carries, and the claims that are levels.
RUNNABLE = (
    ".app", ".apk", ".appimage", ".application", ".bat", ".bin", ".cmd", ".com", ".command", ".cpl", ".csh", ".deb", ".desktop",
    ".dll", ".dmg", ".exe", ".gadget", ".hta", ".inf", ".ins", ".isp", ".jar", ".js", ".jse", ".ksh", ".lnk",
    ".msc", ".msi", ".msp", ".pif", ".pkg", ".pl", ".ps1", ".ps2", ".psc1", ".py", ".rb", ".reg", ".rpm",
    ".run", ".scf", ".scr", ".sct", ".sh", ".so", ".url", ".vb", ".vbe", ".vbs", ".workflow", ".ws", ".wsc",
    ".wsf", ".wsh", ".zsh",
)
CARRIED = "Text Highlight Underline StrikeOut Squiggly Ink Square Circle Line Polygon PolyLine FreeText Stamp Caret FileAttachment".split()
LEVELS = "1A 1B 2A 2B 2U 3A 3B 3U 4 4E 4F".split()
#: An attribute of a tag and what stands between a tag's name and its end.
ATTRIBUTE = r"""[\w.-]+:[\w.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""
ATTRIBUTES = r"""(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
#: CJK symbols and kana, Han, compatibility Han, full-width forms.
CJK = r"\x{3000}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"


def text_string(data: Column) -> Column:
    """Text of bytes: UTF-16 or UTF-8 behind a byte order mark, else the document encoding."""
    digits, body = F.hex(data), lambda n: F.substring(data, n + 1, 2**31 - 1)
    special = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0xA1)]))
    return (
        F.when(digits.startswith("FEFF"), F.decode(body(2), "UTF-16BE"))
        .when(digits.startswith("FFFE"), F.decode(body(2), "UTF-16LE"))
        .when(digits.startswith("EFBBBF"), F.decode(body(3), "UTF-8"))
        .otherwise(F.translate(F.decode(data, "ISO-8859-1"), special, LOW_BYTES + HIGH_BYTES))
    )


def packet_properties(packet: Column) -> Column:
    """A map from qualified property to its values, from the descriptions of a metadata packet; a null packet gives null.

    Properties are attributes or elements of a description; an element holds list items, text or else the address it
    refers to, and without any of these it is no property. The last of a name wins, elements after attributes.
    Comments don't count, and attributes may hold any character. Elements within a nested description aren't read.
    """
    body = F.regexp_replace(F.regexp_extract(packet, f"(?s)<rdf:RDF{ATTRIBUTES}>(.*)</rdf:RDF>", 1), "(?s)<!--.*?-->", "")
    return F.when(packet.isNotNull(), _let(body, lambda b: _let(_entries(b), _last_of_each)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once: within lambdas an expression is worked out wherever it stands."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _entries(body: Column) -> Column:
    """Names and values of the properties, attributes first."""
    tags = F.regexp_extract_all(body, F.lit(f"<rdf:Description({ATTRIBUTES})/?>"), F.lit(1))
    attributes = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(t, F.lit(f"({ATTRIBUTE})"), F.lit(1))))
    attributes = F.filter(attributes, lambda a: ~a.rlike("^(xmlns|rdf|xml):"))
    elements = F.regexp_extract_all(body, F.lit(rf"(?s)(<(?!rdf:)([\w.-]+:[\w.-]+){ATTRIBUTES}(?:/>|>.*?</\2\s*>))"), F.lit(1))
    own = lambda a: F.struct(F.regexp_extract(a, r"^([^=\s]+)", 1).alias("k"), F.array(plain(F.regexp_extract(a, r"(?s)=\s*.(.*).$", 1))).alias("v"))
    return F.concat(F.transform(attributes, own), F.filter(F.transform(elements, _held), lambda e: F.size(e["v"]) > 0))


def _held(element: Column) -> Column:
    """Name and values of a property element."""
    items = F.regexp_extract_all(element, F.lit(f"(?s)<rdf:li{ATTRIBUTES}>(.*?)</rdf:li>"), F.lit(1))
    text = F.regexp_extract(element, rf"(?s)^<[\w.:-]+{ATTRIBUTES}>(.*)</[^>]*>$", 1)
    address = F.regexp_extract(element, r"""^<[^>]*?\srdf:resource\s*=\s*["']([^"']*)""", 1)
    some = lambda x: F.when(x != "", F.array(x)).otherwise(F.array().cast("array<string>"))
    told = _let(text, lambda t: F.when(F.trim(t) != "", F.array(t)).otherwise(_let(address, some)))
    values = _let(items, lambda i: F.when(F.size(i) > 0, i).otherwise(told))
    return F.struct(F.regexp_extract(element, r"^<([\w.:-]+)", 1).alias("k"), F.transform(values, plain).alias("v"))


def _last_of_each(entries: Column) -> Column:
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["k"] == n), -1)["v"]
    return _let(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda names: F.map_from_arrays(names, F.transform(names, last)))


def plain(text: Column) -> Column:
    """Text of XML: trimmed, entities resolved, the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def claimed_level(properties: Column) -> Column:
    """The conformance level that a packet's properties claim; null for none and for what isn't a level."""
    value = lambda name: F.element_at(F.try_element_at(properties, F.lit(name)), 1)
    level = F.concat(value("pdfaid:part"), F.coalesce(F.upper(value("pdfaid:conformance")), F.lit("")))
    return F.when(level.isin(LEVELS), level)


def is_runnable(path: Column) -> Column:
    """Whether a file may run code: by its extension, or for lack of one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(["", *RUNNABLE])


def is_carried(subtype: Column) -> Column:
    """Whether form data carries annotations of a subtype."""
    return subtype.isin(CARRIED)


def join_lines(text: Column) -> Column:
    """Lines as one: with nothing between CJK characters, a space elsewhere."""
    return F.regexp_replace(F.regexp_replace(text, f"(?<=[{CJK}])\n(?=[{CJK}])", ""), "\n", " ")


def word_at(text: Column, index: Column) -> Column:
    """start and length (from 0) of the word that a place touches; the place itself with length 0 where it touches none."""
    left = F.length(F.regexp_extract(F.substring(text, F.lit(1), index), rf"([{WORD}]*)\z", 1))
    right = F.length(F.regexp_extract(F.substring(text, index + 1, F.lit(2**31 - 1)), f"^([{WORD}]*)", 1))
    return F.when((index >= 0) & (index <= F.length(text)), F.struct((index - left).alias("start"), (left + right).alias("length")))


def document_number(text: Column) -> Column:
    """A number as documents write it: sign, digits and a point, no exponent; what follows is left, no digit is null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")


def is_visible(layers: Column, hidden: Column, policy: str) -> Column:
    """Whether content in ``layers`` shows when ``hidden`` are off: AnyOn, AllOn, AnyOff or AllOff. Without layers it shows."""
    off = lambda x: F.array_contains(hidden, x)
    shows = {
        "AnyOn": F.exists(layers, lambda x: ~off(x)),
        "AllOn": F.forall(layers, lambda x: ~off(x)),
        "AnyOff": F.exists(layers, off),
        "AllOff": F.forall(layers, off),
    }[policy]
    return (F.size(layers) == 0) | shows
