"""Text functions on columns: HTML to text, lines, chunks, normalisers, hashes, redaction."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Named entities that are decoded; others stay as they are.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
BLOCK_ENDS = "p|div|li|section|article|h[1-6]|tr"
#: White space as browsers and Unicode have it, not only ASCII.
WIDE_SPACE = r"(?U)\s+"
BULLETS = "・●■◆◇※"
#: The characters of WIDE_SPACE, and the mark that a file may begin with.
BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
EDGES = BLANKS + "\ufeff"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Python gets nulls for ASCII texts, for which it changes nothing. `text` is written three times: keep it a plain column."""
    return F.coalesce(_nfkc(F.when(~text.rlike(r"^\p{ASCII}*$"), text)), text)


def _code_point(code: Column) -> Column:
    """The character of a code point (no surrogate)."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numeric_entities(text: Column) -> Column:
    """Decimal and hexadecimal entities of characters; others stay as they are."""

    def one(part: Column) -> Column:
        tens, sixteens = F.regexp_extract(part, "^0*([0-9]{1,7});", 1), F.regexp_extract(part, "^[xX]0*([0-9a-fA-F]{1,6});", 1)
        code = F.when(tens != "", tens.cast("long")).when(sixteens != "", F.conv(sixteens, 16, 10).cast("long"))
        fits = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(fits, F.concat(_code_point(code), F.regexp_replace(part, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), part))

    return let(F.split(text, "&#"), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), ""))


def decode_entities(text: Column) -> Column:
    """Decimal, hexadecimal and the named entities, in one left-to-right sense: `&amp;lt;` gives `&lt;`. Native, and usable inside higher-order functions."""
    numeric = lambda t: F.when(t.contains("&#"), _numeric_entities(t)).otherwise(t)
    return let(text, lambda t: F.when(t.contains("&"), let(numeric(t), decode_entities_named)).otherwise(t))


def js_trim(text: Column) -> Column:
    """Strip all white space at both ends, line breaks and wide blanks too."""
    return F.trim(text, F.lit(EDGES))


def html_to_text(html: Column) -> Column:
    """Scripts, styles, line breaks and block ends become line breaks, other tags a blank; entities decoded, white space squeezed."""
    text = F.coalesce(html, F.lit(""))

    def without(t: Column) -> Column:
        for tag in ("script", "style", "noscript"):
            t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "\n")
        return t

    # most texts have none of these, and a search through all of a text costs more than any other step
    text = let(text, lambda t: F.when(t.rlike(r"(?i)</(?:no)?s(?:cript|tyle)>"), without(t)).otherwise(t))
    text = F.regexp_replace(text, rf"(?i)<(?:br\s*/?|/(?:{BLOCK_ENDS}))>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", " "))
    text = F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), "[ \t]{2,}|\t", " ")
    text = F.replace(text, F.lit("\n "), F.lit("\n"))
    text = let(text, lambda t: F.when(t.contains("\n\n\n"), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t))
    return js_trim(text)


def lines_of(text: Column, bullets: str = BULLETS) -> Column:
    """Lines without leading bullets and white space, empty ones dropped."""
    cleaned = F.transform(F.split(text, "\n"), lambda s: js_trim(F.ltrim(s, F.lit(BLANKS + bullets))))
    return F.filter(cleaned, lambda s: s != "")


def distinct_lines(lines: Column) -> Column:
    """The first of the lines that are equal but for white space and case, in their order: two sorts, no comparison of each line with each."""
    keyed = F.transform(lines, lambda s, i: F.struct(F.lower(F.regexp_replace(s, WIDE_SPACE, "")).alias("key"), i.alias("i"), s.alias("line")))
    firsts = lambda by_key: F.filter(by_key, lambda s, j: (j == 0) | (F.get(by_key, j - 1)["key"] != s["key"]))
    in_order = F.array_sort(F.transform(let(F.array_sort(keyed), firsts), lambda s: F.struct(s["i"].alias("i"), s["line"].alias("line"))))
    return F.transform(in_order, lambda s: s["line"])


def overlapping_chunks(text: Column, longest: int = 1400, size: int = 1200, overlap: int = 220) -> Column:
    """Texts over `longest` characters as pieces of `size` that share `overlap`; others whole."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) <= longest, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size))))


def semantic_lines(text: Column, labels: list[str]) -> Column:
    """Break before labels and behind sentence ends; long lines in overlapping chunks."""
    marked = F.regexp_replace(text, "(" + "|".join(labels) + ")", "\n$1") if labels else text
    parts = F.split(F.regexp_replace(marked, "([。！？!?])", "$1\n"), "\n")
    whole = F.filter(F.transform(parts, js_trim), lambda s: s != "")
    return F.flatten(F.transform(whole, lambda s: overlapping_chunks(s)))


def context_windows(text: Column, pattern: str, radius: int, most: int) -> Column:
    """Up to `most` windows of `radius` characters around the matches of pattern."""
    parts = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1"), "\u0001")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    # where a match begins: one pass with a running length, over no more parts than windows are wanted
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found"))
    starts = F.aggregate(F.slice(parts, F.lit(1), F.least(F.lit(most), F.size(parts) - 1)), start, step, lambda s: s["found"])
    return F.transform(starts, lambda s: F.substring(text, F.greatest(s - radius, F.lit(0)) + 1, F.least(s, F.lit(radius)) + F.lit(radius)))


def meta_content(html: Column, name: str) -> Column:
    """Content of the meta tag of that name or property, either attribute first."""
    key = rf'(?:name|property)=["\']{name}["\']'
    first = F.regexp_extract(html, rf'(?is)<meta\b[^>]*{key}[^>]*content=["\']([^"\']*)["\']', 1)
    second = F.regexp_extract(html, rf'(?is)<meta\b[^>]*content=["\']([^"\']*)["\'][^>]*{key}', 1)
    return decode_entities(let(first, lambda f: F.when(f != "", f).otherwise(second)))


def tag_text(html: Column, tag: str) -> Column:
    """Text of the first such element."""
    return html_to_text(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def image_alts(html: Column) -> Column:
    """Alternative texts of the images, decoded, empty ones dropped, first of equal ones kept."""
    alts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?is)<img\b[^>]*\balt=["\']([^"\']*)["\']'), 1)
    return F.array_distinct(F.filter(F.transform(alts, lambda a: js_trim(decode_entities(a))), lambda a: a != ""))


def decode_entities_named(text: Column) -> Column:
    """Named entities only: usable inside higher-order functions."""
    out = text
    for name, value in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", value)
    return out


def section_after(lines: Column, label: Column | str, stops: list[str], most: int = 3, with_label: bool = True) -> Column:
    """The text behind a label: the rest of its line and up to `most` lines after, until a line that starts with a stop label.

    lines: array of strings; "" where no line starts with the label.
    """
    label = F.lit(label) if isinstance(label, str) else label
    def read(ls: Column) -> Column:
        at = F.array_position(F.transform(ls, lambda s: s.startswith(label)), True).cast("int")
        behind = F.slice(ls, at + 1, most)
        ends = F.array_position(F.transform(behind, lambda s: _starts_any(s, stops)), True).cast("int")
        taken = F.when(ends > 0, F.slice(behind, F.lit(1), F.greatest(ends - 1, F.lit(0)))).otherwise(behind)
        own = js_trim(F.regexp_replace(F.substring(F.element_at(ls, F.greatest(at, F.lit(1))), F.length(label) + 1, F.length(F.element_at(ls, F.greatest(at, F.lit(1))))), r"^[:：\s]+", ""))
        whole = F.concat(F.array(own), taken) if with_label else taken
        return F.when(at > 0, F.array_join(F.filter(whole, lambda s: s != ""), "\n")).otherwise(F.lit(""))

    return let(lines, read)


def _starts_any(s: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | s.startswith(p)
    return hit


def line_windows(lines: Column, before: int, after: int) -> Column:
    """For each line the text of the lines [i - before, i + after)."""
    return F.transform(lines, lambda s, i: F.array_join(F.slice(lines, F.greatest(i - before, F.lit(0)) + 1, F.least(i, F.lit(before)) + F.lit(after)), "\n"))


def normalised(text: Column, drop: str | None = None, keep: str = "a-z0-9ぁ-んァ-ヶ一-龠") -> Column:
    """Matching key: NFKC, lower case, words in `drop` (a pattern) taken out, then only characters of `keep`."""
    out = F.lower(nfkc(F.coalesce(text, F.lit(""))))
    if drop:
        out = F.regexp_replace(out, drop, "")
    return F.regexp_replace(out, f"[^{keep}]+", "")


@dataclass(frozen=True)
class Normaliser:
    """How names become keys. entities: decoded first. drop: words taken out, pattern after pattern. off: characters taken out."""

    drop: tuple[str, ...] = ()
    off: str = "[^a-z0-9ぁ-んァ-ヶ一-龠]+"
    entities: bool = False


_MARKS = r"[\s\x{3000}「」『』【】［］\[\]()（）・･\-‐‑‒–—―_]"
#: The six kinds of keys. They are not interchangeable.
NORMALISERS = {
    "dedupe": Normaliser(("ポケモンカードゲーム|ポケモンカード|ポケカ|抽選販売|招待リクエスト|予約販売|受付開始|応募開始", "box|ボックス|シュリンク付き|1箱|一箱")),
    "gate": Normaliser(("ポケモンカードゲーム|ポケモンカード|ポケカ", "抽選販売|予約販売|招待リクエスト|応募受付|box|ボックス|1箱|一箱")),
    "groups": Normaliser(("ポケモンカードゲーム|ポケモンカード|ポケカ|mega",)),
    "catalog": Normaliser(("ポケモンカードゲーム", _MARKS, "抽選販売|抽選受付|予約販売|応募フォーム|再販"), "", entities=True),
    "identity": Normaliser((r"https?://\S+",), _MARKS),
    "destination": Normaliser(),
}


def key_of(text: Column, kind: str) -> Column:
    """A name's key of one of the six kinds: NFKC, lower case, without the kind's words and characters. `text` should be a plain column."""
    rules = NORMALISERS[kind]
    plain = F.coalesce(text, F.lit(""))
    out = F.lower(nfkc(decode_entities(plain) if rules.entities else plain))
    for pattern in (*rules.drop, rules.off):
        out = F.regexp_replace(out, pattern, "") if pattern else out
    return js_trim(out)


def first_alias(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that is found, else the text itself."""
    out = text
    for pattern, name in reversed(aliases):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def short_hash(*parts: Column | str, length: int = 24) -> Column:
    """Leading hex digits of the SHA-256 of the parts (columns or their names), joined by line breaks."""
    joined = F.concat_ws("\n", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def fingerprint(html: Column, longest: int = 500_000) -> Column:
    """SHA-256 of a page's text without session tokens and hashes: equal for pages that read the same. For tables see with_fingerprint."""
    return fingerprint_of_text(html_to_text(html), longest)


def fingerprint_of_text(plain: Column, longest: int = 500_000) -> Column:
    """The same of a page's text; plain is written several times, so it should be a column."""
    text = F.regexp_replace(nfkc(plain), r"""(?i)\b(?:csrf|nonce|token)[-_:=\s"']+[a-z0-9_-]{12,}\b""", " ")
    text = F.regexp_replace(text, r"(?i)\b[a-f0-9]{32,64}\b", " ")
    return F.sha2(F.left(js_trim(F.regexp_replace(text, WIDE_SPACE, " ")), F.lit(longest)), 256)


def with_fingerprint(pages: DataFrame, html: str, name: str = "fingerprint") -> DataFrame:
    """pages with the fingerprint of their HTML. The text is a projection of its own, so it is worked out once."""
    return pages.withColumn("_plain", html_to_text(F.col(html))).withColumn(name, fingerprint_of_text(F.col("_plain"))).drop("_plain")


def redact(message: Column, longest: int = 180) -> Column:
    """Error text without addresses and home paths, at most so many characters."""
    out = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?i)https?://\S+", "[URL]")
    return F.left(F.regexp_replace(out, r"(?i)/home/runner/work/\S+", "[PATH]"), F.lit(longest))


def markdown_cell(text: Column) -> Column:
    """Text for a table cell: bars escaped, line breaks as blanks."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), "[\r\n]+", " ")


def ocr_repair(text: Column) -> Column:
    """Glyphs that recognisers confuse inside dates: O as zero, I, l and | as one, between digits or date marks, and in numbers parted by date marks."""
    out = F.regexp_replace(text, r"(?<=[0-9/月:年])[Oo](?=[0-9/月日:年時])|(?<=[0-9])[Oo]|[Oo](?=[0-9])", "0")
    out = F.regexp_replace(out, r"(?<=[0-9/月:年])[Il|](?=[0-9/月日:年時])|(?<=[0-9])[Il|](?=[0-9])", "1")
    return repaired_numbers(out)


def repaired_numbers(text: Column, letters: str = "OoIl|", digits: str = "00111") -> Column:
    """Numbers that date marks part (two or three of them), with the letters in them as the digits that they stand for: 2O26/O7/1l."""
    number, mark = f"[0-9{letters}]", r"[/.\-]"
    run = rf"(?<![0-9A-Za-z_])({number}{{1,4}}{mark}{number}{{1,2}}(?:{mark}{number}{{1,2}})?)(?![0-9A-Za-z_])"
    parts = F.split(F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit("")), run, "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, letters, digits)).otherwise(p)), "")


def non_empty(*cols: Column) -> Column:
    """The first that is neither null nor empty, else the empty string. Each is worked out once, and only if those before it gave nothing; Spark writes what nullif is given twice."""
    return F.coalesce(*[let(c, lambda v: F.when(v != "", v)) for c in cols], F.lit(""))


def to_base64(text: Column) -> Column:
    return F.base64(F.encode(text, "UTF-8"))


def from_base64(text: Column) -> Column:
    return F.decode(F.unbase64(text), "UTF-8")
