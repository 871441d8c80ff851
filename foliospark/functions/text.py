"""Text functions as Column expressions; they stay inside generated code, except where one says that it is a vectorised UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions import pure
from foliospark.functions.fold import let

# Fixed values throughout: the patterns of markers, entities, references and markup define the results of the page format.

#: White space of the page format, for Java patterns.
S = r"[\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

LINE_START = r"(?:^|(?<=[\n\r\x{2028}\x{2029}]))"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{S}+|{S}+$", "")


def normalized_text(c: Column) -> Column:
    """Lower case, and only digits, a to z and Hangul syllables."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]", "")


def _replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, *p), pairs, c)


def _where(c: Column, sign: str, f: Callable[[Column], Column]) -> Column:
    """``f``, which changes nothing in a text without ``sign``, of texts that have it: most have no markup, and patterns are dear."""
    return let(c, lambda t: F.when(t.contains(sign), f(t)).otherwise(t))


def decode_entities(c: Column) -> Column:
    """Six named entities, in any case, each once: what ``&amp;`` gives is not decoded again."""
    return _replaced(c, [(f"(?i)&{k};", v) for k, v in reversed(pure.ENTITIES.items())])


def xml_decode(c: Column) -> Column:
    """The five entities of XML, in lower case, the ampersand last."""
    for name, by in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(by))
    return c


def xml_escape(c: Column) -> Column:
    for by, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        c = F.replace(c, F.lit(by), F.lit(f"&{name};"))
    return c


def _nfkc(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import unicodedata

    for column in columns:
        # some texts at a time: as Python's strings a batch is several times as large
        parts = (column.slice(i, 64).to_pylist() for i in range(0, len(column), 64))
        yield pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in part], pa.string()) for part in parts)])


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def guarded(f: Callable[[Column], Column], c: Column, plain: Column, else_: Column | None = None) -> Column:
    """``f``, a UDF, of ``c`` for rows that are not ``plain``; those have ``else_``, or ``c`` as it is.

    A UDF runs for every row whatever stands around it; plain rows give it null, which it returns at once.
    """
    return F.when(plain, c if else_ is None else else_).otherwise(f(F.when(~plain, c)))


def nfkc(c: Column, plain: Column | None = None) -> Column:
    """NFKC; a vectorised UDF, and only for texts that are not ASCII (or not ``plain``, where that is cheaper to know)."""
    return guarded(F.arrow_udf(_nfkc, "string"), c, is_ascii(c) if plain is None else plain)


def comparable_text(c: Column, *, normalize: bool = True) -> Column:
    """What of Markdown is compared: no markup, NFKC (if ``normalize``), no white space."""
    text = _where(c, "&", decode_entities)
    text = _where(text, "<", lambda t: F.regexp_replace(t, r"(?s)<!--.*?-->", " "))
    text = _where(text, "[", lambda t: _replaced(t, [(r"!\[([^\]]*)\]\([^)]*\)", " $1 "), (r"\[([^\]]+)\]\([^)]*\)", " $1 ")]))
    text = _where(text, "<", lambda t: _replaced(t, [(r"(?i)</(?:td|th)>", " "), (r"(?i)</tr>", "\n"), (r"<[^>]+>", " ")]))
    text = _replaced(text, [(LINE_START + r"[\t ]{0,3}(?:#{1,6}|[-*+]|\d+\.)[\t ]+", ""), (r"[*_`~>|]", " ")])
    # what replaces anything is ASCII, so an ASCII text stays one
    return F.regexp_replace(nfkc(text, is_ascii(c)) if normalize else text, f"{S}+", "")


def cell_text(c: Column) -> Column:
    return strip(_replaced(decode_entities(c), [("<[^>]+>", " "), (f"{S}+", " ")]))


def adjacent_text(c: Column) -> Column:
    """A new paragraph before section numbers (``3.1 ``) and markers (``2)``)."""
    return strip(_replaced(c, [(rf"{S}+(?=\d+(?:\.\d+)+{S})", "\n\n"), (rf"{S}+(?=\d+\))", "\n\n")]))


_LONG = 4_000_000  # cells of the built-in matrix, beyond which the distance of two texts is not left to it


def similarity(a: Column, b: Column) -> Column:
    a, b = normalized_text(a), normalized_text(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def similar(a: Column, b: Column, least: float) -> Column:
    """Whether similarity is ``least`` or more; the distance is given up beyond what that allows."""
    a, b = normalized_text(a), normalized_text(b)
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor((1 - least) * longest + 1e-9).cast("int")
    near = F.call_function("levenshtein", a, b, most) >= 0  # of the matrix a band of that width; -1 beyond it
    return (longest > 0) & (F.abs(F.length(a) - F.length(b)) <= most) & near


def _within(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for arrays in columns:
        yield pa.array([None if None in (x := tuple(v.as_py() for v in row)) else pure.within(*x) for row in zip(*arrays, strict=True)], pa.bool_())


def within(a: Column, b: Column, most: Column) -> Column:
    """Whether the distance of two texts is ``most`` or less; a vectorised UDF that gives up beyond it, for texts of any length."""
    return F.arrow_udf(_within, "boolean")(a, b, most.cast("bigint"))


def _error_rates(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in columns:
        yield pa.array([None if x is None or y is None else pure.error_rate(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())


def character_error_rate(expected: Column, actual: Column) -> Column:
    """Distance over the expected length in UTF-16 units; a UDF for long texts, which goes by diagonals, and for those with characters beyond such units."""
    astral = (F.length(expected).cast("bigint") * F.length(actual) > _LONG) | F.concat(expected, actual).rlike(r"[\x{10000}-\x{10FFFF}]")
    rate = F.arrow_udf(_error_rates, "double")
    plain = F.when(F.length(expected) == 0, F.when(F.length(actual) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(expected, actual) / F.length(expected))
    return F.when(astral, rate(F.when(astral, expected), F.when(astral, actual))).otherwise(plain)  # a UDF runs for every row: others give it null


def numbered_marker(c: Column) -> Column:
    """The number of a text that begins with a marker such as ``3)``, else null."""
    return F.regexp_extract(strip(c), r"^(\d{1,3})\)", 1).try_cast("int")


def marker_numbers(c: Column) -> Column:
    """Distinct numbers before a (possibly escaped) closing parenthesis, anywhere."""
    found = F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z0-9_])(\d{{1,3}}){S}*\\?\)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def marker_place(c: Column, number: Column) -> Column:
    """0-based place of the line that a number marks, -1 without one; it may be the line break before."""
    pattern = F.concat(F.lit(rf"(?:\n|{LINE_START})[\t ]{{0,3}}"), number.cast("string"), F.lit(rf"{S}*\\?\)[\t ]*"))
    return F.regexp_instr(c, pattern) - 1


def start_of(c: Column, size: int = 8) -> Column:
    """The first ``size`` normalised characters, or all if there are fewer; what follows them is not gone through."""
    kept = "0-9a-z가-힣"
    return F.regexp_replace(F.regexp_extract(F.lower(c), f"^(?:[^{kept}]*[{kept}]){{0,{size}}}", 0), f"[^{kept}]", "")


def same_start(a: Column, b: Column, size: int = 8) -> Column:
    a, b = start_of(a, size), start_of(b, size)
    return (F.length(a) >= size) & (a == b)


def escape_markers(c: Column) -> Column:
    """``1)`` at the start of a line outside tables becomes ``1\\) ``; running it twice changes nothing more."""
    parts = F.split(c, r"(?is)(?=<table\b)|(?<=</table>)")
    fixed = F.transform(parts, lambda p: F.when(p.rlike(r"(?is)^<table\b.*</table>$"), p).otherwise(F.regexp_replace(p, r"(^|\n)([\t ]{0,3})(\d{1,3})\)[\t ]*", r"$1$2$3\\) ")))
    return F.array_join(fixed, "")


def normalize_markdown(c: Column) -> Column:
    return strip(F.replace(c, F.lit("\r\n"), F.lit("\n")))


def replace_reference(c: Column, old: Column, new: Column) -> Column:
    return F.replace(c, old, new)


def table_cell(c: Column) -> Column:
    """A text as a cell of a Markdown table."""
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(c, "\r?\n", " ")


def portable_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def page_id(c: Column) -> Column:
    return F.format_string("page-%04d", c)


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r".(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def kst(c: Column) -> Column:
    """A timestamp as text of Korean time; sessions keep time in UTC."""
    return F.concat(F.date_format(F.from_utc_timestamp(c, "Asia/Seoul"), "yyyy-MM-dd HH:mm:ss"), F.lit(" KST"))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def url_decoded(c: Column) -> Column:
    """Percent escapes decoded, a plus sign kept; null where an escape is broken."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _encode_uri(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from urllib.parse import quote

    for column in columns:
        yield pa.array([None if x is None else quote(x, safe=";,/?:@&=+$-_.!~*'()#") for x in column.to_pylist()], pa.string())


def encode_uri(c: Column) -> Column:
    """Percent escapes for all but URI characters; a vectorised UDF only where there is something to escape."""
    return guarded(F.arrow_udf(_encode_uri, "string"), c, c.rlike(r"^[A-Za-z0-9;,/?:@&=+$\-_.!~*'()#]*$"))


def image_references(c: Column) -> Column:
    """Targets of Markdown images, then of HTML images, repeats kept."""
    markdown = F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)(?:\s+[\"'][^\"']*[\"'])?\)"), F.lit(1))
    html = F.regexp_extract_all(c, F.lit(r"(?i)<img\b[^>]*\bsrc\s*=\s*([\"'])(.*?)\1[^>]*>"), F.lit(2))
    none = F.array().cast("array<string>")
    return F.concat(F.when(c.contains("!["), markdown).when(c.isNotNull(), none), F.when(c.contains("<"), html).when(c.isNotNull(), none))


def local_references(c: Column) -> Column:
    """Distinct image targets that are neither absolute nor of a scheme, in order of first appearance."""
    local = lambda r: ~r.rlike(r"(?i)^(?:[a-z]+:|#|/)") & ~r.startswith("\\")
    return F.filter(F.array_distinct(image_references(c)), local)


def safe_entry(c: Column) -> Column:
    """Whether an archive member's name stays inside the archive."""
    name = portable_path(c)
    return ~name.startswith("/") & ~F.exists(F.split(name, "/"), lambda p: p == "..")


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def _anchors(width: int, gram: int) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if x is None else pure.anchors(x.encode(), width, gram) for x in column.to_pylist()], pa.list_(pa.int64()))

    return run


def anchors(c: Column, width: int = 24, gram: int = 8) -> Column:
    """Hashes of grams such that any two texts that share ``width`` bytes share one; about two for each ``width`` - ``gram`` bytes.

    Of each window of ``width`` bytes the gram of least hash is taken, so what is looked up is an equi-join, not a search.
    """
    return F.arrow_udf(_anchors(width, gram), "array<bigint>")(c)
