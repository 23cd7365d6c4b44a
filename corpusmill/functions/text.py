"""Text functions: each takes a Column (or a column name) and gives a Column, without Python UDFs.

Patterns carry ``(?U)`` where white space or letters beyond ASCII count. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks trimmed from claims, connectives and labels that rules know, markers.
TRIM_NORMAL = " -:;,.!?。！？；：()[]{}\"'"
TRIM_CLEAN = " -:;,.!?。！？；：，、()[]{}\"'"
CONNECTIVES = "因此|所以|同时|此外|另外|不过|但是|而且|并且|而是"
NEGATIONS = ("not ", "no ", "never ", "cannot ")
NOTE_LABELS = ("案例", "示例", "例子", "提示", "注意", "说明")
EVALUATIONS = ("better", "worse", "useful", "important", "effective")
BOILERPLATE_HEADINGS = (
    "原文概览 / source overview", "核心观点 / key points", "知识声明 / claims", "证据切块 / chunks", "后续建议 / next steps", "概念摘要 / concept summary", "核心陈述 / canonical claim", "支撑声明 / supporting claims",
    "来源页面 / source pages", "来源证据 / source evidence", "审核提示 / review notes", "工作区综述 / workspace overview", "稳定概念 / stable concepts", "来源覆盖 / source coverage", "维护状态 / maintenance",
)
QUESTION_HEADINGS = (r"(?U)^(.{1,32}?)\s*[是指]?什么\s+(.+)$", r"(?U)^什么是\s+(.{1,32}?)\s+(.+)$")
#: What white space is under ``(?U)``.
BLANKS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Prose: words of Latin, Greek and Cyrillic letters between single blanks, with marks that mean nothing to the rules below but where texts are cut and trimmed.
#: No digits, line ends, colons, slashes, brackets and marks of Markdown, no hyphen in front.
#: The characters of one byte are listed one by one, which patterns look up at once.
PROSE_CHARS = "".join(f"\\x{c:02x}" for c in (*range(0x21, 0x7F), *range(0xA1, 0x100)) if chr(c) not in "#*+`~<>_[:/0123456789") + r"\u0100-\u024F\u0370-\u052F"
PROSE = rf"\A(?!-)(?:[{PROSE_CHARS}]+ ?)++(?<! )\z"
NO_SECTION = "未命名章节"
PREAMBLE = "文档开始"

Text = Column | str


def col(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Text, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(col(x)), f), F.lit(0))


def sub(x: Text, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(col(x), pattern, to)


def strip(x: Text) -> Column:
    """Without white space at either end."""
    return F.btrim(col(x), F.lit(BLANKS))


def squeezed(x: Text) -> Column:
    """Each run of white space as one blank; single blanks, the most of it, are passed over."""
    return sub(x, r"(?U)\s{2,}|[^\S ]", " ")


def non_blank(x: Text) -> Column:
    """The stripped text, null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def first_non_blank(*values: Text) -> Column:
    return F.coalesce(*(non_blank(v) for v in values), F.lit(""))


def any_of(x: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def where_has(x: Text, marks: tuple[str, ...], f) -> Column:
    """f of texts that hold one of the marks, others as they are: for rules that change nothing without their marks."""
    return let(x, lambda v: F.when(any_of(v, marks), f(v)).otherwise(v))


def prose(x: Column) -> Column:
    """Whether a text is prose, which most rules leave as it is: one pass over it instead of theirs."""
    return x.rlike(PROSE)


def unless_prose(x: Text, plainly, f, known: Column | None = None) -> Column:
    """f of a text; of prose, ``plainly``, which must say the same of it. ``known``: whether the text is prose, where a column says so."""
    if known is not None:
        return F.when(known, plainly(col(x))).otherwise(let(x, f))
    return let(x, lambda v: F.when(prose(v), plainly(v)).otherwise(f(v)))


def normalize_document(x: Text) -> Column:
    """LF line ends, no white space at line ends or around the text, one final line end."""
    lines = sub(sub(x, "\r\n?", "\n"), r"(?U)[^\S\n]+(?=\n|\z)")
    return F.concat(strip(lines), F.lit("\n"))


#: Rules from Markdown to plain text, in order: marks without which a rule changes nothing, pattern and replacement.
PLAIN_RULES = (
    (("<!--",), r"(?s)<!--.*?-->", " "), (("#",), r"(?Um)^#{1,6}\s+", ""), (("-", "*", "+"), r"(?Um)^\s*[-*+]\s+", ""), ((".",), r"(?Um)^\s*\d+\.\s+", ""), (("`",), r"`{1,3}", ""),
    (("](",), r"\[([^\n]*?)\]\(([^\n]*?)\)", "$1"), (("*", "__", "~~"), r"\*|__|~~", ""), ((), r"[ \t]{2,}|\t", " "), ((), r"(?Um)^[^\S\n]+|[^\S\n]+$", ""), (("\n\n\n",), r"\n{3,}", "\n\n"),
)


def plain_text(x: Text) -> Column:
    """Markdown without its marks: comments, headings, bullets, code ticks, links, emphasis; blanks squeezed."""
    return unless_prose(x, lambda v: v, _plain_text)


def _plain_text(x: Column) -> Column:
    for marks, pattern, to in PLAIN_RULES:
        x = where_has(x, marks, lambda v, pattern=pattern, to=to: sub(v, pattern, to)) if marks else sub(x, pattern, to)
    return strip(x)


def without_fences(x: Text) -> Column:
    """Without fenced code: lines from an opening fence to the closing one, or to the end."""
    return where_has(x, ("```",), lambda v: sub(v, r"(?m)^[ \t]*```[^\n]*(?:\n(?![ \t]*```)[^\n]*)*(?:\n[ \t]*```[^\n]*|\z)\n?"))


def inline_text(x: Text) -> Column:
    """A line without link targets and emphasis."""
    x = where_has(strip(x), ("](",), lambda v: sub(v, r"\[([^\n]*?)\]\(([^\n]*?)\)", "$1"))
    x = where_has(x, ("**", "__", "~~"), lambda v: sub(v, r"\*\*|__|~~"))
    return strip(F.btrim(x, F.lit("`*_ ")))


def normal_claim(x: Text, known: Column | None = None) -> Column:
    """The text by which claims are equal."""
    return F.btrim(unless_prose(x, F.lower, _normal_claim, known), F.lit(TRIM_NORMAL))


def _normal_claim(x: Column) -> Column:
    lines = F.when(by_line(x), F.split(x, "\n", -1)).otherwise(F.array(x))
    return squeezed(F.array_join(F.transform(lines, lambda v: F.lower(F.when(prose(v), v).otherwise(_plain_text(v)))), "\n"))


def heading_body(x: Column) -> Column:
    """A question heading that a body repeats, as ``X 是什么 X…`` and ``什么是 X X…``, goes; both parts are compared as titles."""

    def body(title: Column, pattern: str) -> Column:
        parts = F.struct(concept_title(F.regexp_extract(title, pattern, 1)).alias("label"), concept_title(F.regexp_extract(title, pattern, 2)).alias("rest"))
        return let(parts, lambda p: F.when((p["label"] != "") & F.startswith(p["rest"], p["label"]), p["rest"]))

    found = let(concept_title(x), lambda title: F.coalesce(*(body(title, pattern) for pattern in QUESTION_HEADINGS), x))
    return F.when(F.contains(x, F.lit("什么")), found).otherwise(x)  # both patterns hold it


#: What goes from the front of a claim, each once and in this order: heading, quote, bullet, number, number in brackets, connective.
CLAIM_FRONT = "(?U)^" + "".join(f"(?:{p})?" for p in (r"\s{0,3}#{1,6}\s*", r"\s*>\s*", r"\s*[-*+]\s*", r"\s*\d+[.)、:：]\s*", r"\s*[（(]?\d+[）)]\s*", rf"\s*(?:{CONNECTIVES})\s*"))


def clean_claim(x: Text) -> Column:
    """A candidate without comment, heading, quote, bullet, number and connective in front, squeezed and trimmed."""
    return F.btrim(unless_prose(x, lambda v: v, _clean_claim), F.lit(TRIM_CLEAN))


def _clean_claim(x: Column) -> Column:
    x = where_has(strip(x), ("<!--",), lambda v: sub(v, r"(?s)<!--.*?-->", " "))
    return squeezed(let(sub(x, CLAIM_FRONT), heading_body))


def natural_chars(x: Column) -> Column:
    """How many letters and digits."""
    return F.length(sub(x, r"[^\p{L}\p{N}]+"))


def noise(cleaned: Column) -> Column:
    """Whether a cleaned candidate is no claim: empty, links, chat metadata, ``word:`` labels, dates, rules, paths, under 4 letters."""
    return unless_prose(cleaned, few_letters, _noise)


def few_letters(x: Column) -> Column:
    """Fewer than four letters and digits."""
    return ~x.rlike(r"^(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]){4}")


def _noise(cleaned: Column) -> Column:
    low = F.lower(cleaned)
    return (
        (cleaned == "")
        | cleaned.rlike(r"^(?:https?|file)://")
        | any_of(low, ("turn_id", "speaker:", "time:"))
        | (F.contains(cleaned, F.lit(":")) & cleaned.rlike(r"(?U)\b[A-Za-z][A-Za-z0-9_ -]{0,24}\s*:"))
        | cleaned.rlike(r"(?U)^\d{4}-\d{2}-\d{2}$")
        | cleaned.rlike(r"^[-|: ]{3,}$")
        | ((F.length(cleaned) - F.length(F.replace(cleaned, F.lit("/"))) >= 3) & (F.length(cleaned) < 48))
        | low.rlike(r"^(?:raw|\.\./raw|wiki|claims|chunks|normalized)/")
        | few_letters(cleaned)
    )


def short_gray_zone(x: Text) -> Column:
    """Claims of 4 to 9 letters."""
    return let(clean_claim(x), lambda c: (c != "") & (natural_chars(c) < 10) & ~_noise(c))


def stands_alone(cleaned: Column) -> Column:
    """A claim that is not noise; no prefixes count as dependent."""
    return let(cleaned, lambda c: (c != "") & ~_noise(c))


def iso_date_label(x: Text) -> Column:
    return clean_claim(x).rlike(r"(?U)^\d{4}-\d{2}-\d{2}$")


def question_like(x: Text) -> Column:
    """Never true: cleaning trims question marks."""
    return clean_claim(x).rlike("[？?]$")


def claim_type(x: Text, known: Column | None = None) -> Column:
    cleaned = unless_prose(x, lambda v: v, clean_claim, known)  # trimming takes no letters
    return F.when(let(F.lower(cleaned), lambda v: any_of(v, EVALUATIONS)), "evaluation").otherwise("fact")


def has_negation(x: Text) -> Column:
    """Markers count inside words, as ``piano `` shows."""
    return any_of(F.lower(col(x)), NEGATIONS)


def conflict_base(normal: Column) -> Column:
    """Normal text without negation markers, removed as bare substrings one after another."""
    for marker in NEGATIONS:
        normal = F.replace(normal, F.lit(marker.strip()), F.lit(""))
    return strip(sub(normal, r"(?U)\s+", " "))


def similarity_bucket(normal: Column) -> Column:
    return F.substring(normal, 1, 24)


def tokens(normal: Column) -> Column:
    """Search tokens of a normal text: words of 2 and more, pairs and triples of Chinese characters, other parts between blanks; repeats stay."""

    def grams(chars: Column, n: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(chars) - (n - 1)), lambda i: F.substr(chars, i, F.lit(n)))
        return F.when(F.length(chars) >= n, each).otherwise(F.array().cast("array<string>"))

    def all_of(x: Column) -> Column:
        words = F.filter(F.regexp_extract_all(x, F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 2)
        found = F.concat(words, let(sub(x, "[^一-鿿]+"), lambda chars: F.concat(grams(chars, 2), grams(chars, 3))))
        parts = F.filter(F.split(x, r"(?U)\s+"), lambda t: F.length(t) >= 2)
        return let(found, lambda f: F.concat(f, F.array_except(parts, f)))

    return let(normal, all_of)


def similarity_tokens(normal: Column) -> Column:
    """Distinct tokens of the negation-free text, in order."""
    return base_tokens(conflict_base(normal))


def base_tokens(base: Column) -> Column:
    """``similarity_tokens`` of a text that is negation-free already."""
    return F.array_distinct(F.filter(tokens(F.btrim(base, F.lit(TRIM_NORMAL))), lambda t: F.length(F.trim(t)) >= 2))


def token_weight(t: Column) -> Column:
    """Half the length (up to 8), at least 1, of plain words; the length up to 4 of others."""
    return F.when(t.rlike("^[a-z0-9_]+$"), F.greatest(F.lit(1.0), F.least(F.length(t), F.lit(8)) / 2.0)).otherwise(F.least(F.length(t), F.lit(4)).cast("double"))


def total_weight(ts: Column) -> Column:
    return F.aggregate(ts, F.lit(0.0), lambda a, t: a + token_weight(t))


def token_overlap(left: Column, right: Column) -> Column:
    """Struct of overlap ratio, Jaccard ratio and shared tokens, by weight."""
    shared = F.array_intersect(left, right)
    w, a, b = total_weight(shared), total_weight(F.array_distinct(left)), total_weight(F.array_distinct(right))
    some = (F.size(left) > 0) & (F.size(right) > 0)
    return F.struct(
        F.when(some, w / F.greatest(F.lit(1.0), F.least(a, b))).otherwise(0.0).alias("overlap"),
        F.when(some, w / F.greatest(F.lit(1.0), a + b - w)).otherwise(0.0).alias("jaccard"),
        F.when(some, F.size(shared)).otherwise(0).alias("shared"),
    )


def distinct_parts(parts: Column) -> Column:
    """Distinct non-blank strings of an array, stripped, in order."""
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda p: p != ""))


def primary_pieces(x: Text) -> Column:
    """Pieces at sentence marks and line ends."""
    return F.split(col(x), r"(?U)(?<=[。！？!?；;])\s*|\n+|(?<=\.)\s{2,}", -1)


def clauses(cleaned: Column, most: int = 140) -> Column:
    """A longer claim's clauses, if two or more of them are claims; else nothing."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(cleaned, r"(?U)(?<=[,;。！？!?；])\s*", -1), clean_claim), lambda p: ~_noise(p))
    return F.when(F.length(cleaned) > most, let(parts, lambda ps: F.when(F.size(ps) >= 2, ps).otherwise(none))).otherwise(none)


def _prose_pieces(x: Column, most: int = 140) -> Column:
    """``_pieces`` of prose, where cleaning is trimming, sentences end at three marks and clauses at commas, and trimming takes all of these."""
    none = F.array().cast("array<string>")
    kept = lambda parts: F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(TRIM_CLEAN))), lambda p: ~few_letters(p))
    cut = lambda p: let(kept(F.split(p, ",", -1)), lambda ps: F.when(F.size(ps) >= 2, ps).otherwise(none))
    with_clauses = lambda p: F.when((F.length(p) > most) & F.contains(p, F.lit(",")), F.concat(F.array(p), cut(p))).otherwise(F.array(p))
    sentences_ = F.when(any_of(x, ("!", "?", ";")), F.split(F.translate(x, "!?;", "\n\n\n"), "\n", -1)).otherwise(F.array(x))
    return F.flatten(F.transform(kept(sentences_), with_clauses))


def _pieces(x: Column) -> Column:
    """Claims of a text in order: whole sentences, each followed by its clauses."""
    pieces = F.filter(primary_pieces(x), lambda p: ~p.rlike(r"(?U)^\s*#{1,6}\s+\S+"))
    whole = F.filter(F.transform(pieces, clean_claim), lambda p: ~noise(p))
    each = F.flatten(F.transform(whole, lambda p: F.concat(F.array(p), F.filter(clauses(p), lambda c: c != p))))
    return F.filter(F.transform(each, clean_claim), lambda p: ~noise(p))


def _or_whole(found: Column, text: Column) -> Column:
    """Distinct claims found in a text, else the whole text as one."""
    rest = let(clean_claim(text), lambda r: F.when(noise(r), F.array().cast("array<string>")).otherwise(F.array(r)))
    return let(F.array_distinct(found), lambda f: F.when(F.size(f) > 0, f).otherwise(rest))


def claim_candidates(x: Text) -> Column:
    """Distinct claims of a text in order: whole sentences, each followed by its clauses; the whole text if none is left."""
    return let(x, lambda text: _or_whole(_pieces(text), text))


def by_line(x: Column) -> Column:
    """Whether rules from Markdown to plain text and cuts into sentences say of each line what they say of the text: no comments, no fences, no line of marks and numbers alone."""
    return ~any_of(x, ("<!--", "```")) & ~x.rlike(r"(?Um)^[^\S\n]*[-*+#.\d][-*+#.\d\s]*$")


def text_claims(x: Text) -> Column:
    """``claim_candidates`` of a Markdown text as plain text without fenced code, worked out line by line where lines stand for themselves."""

    def found(text: Column) -> Column:
        parts = F.when(by_line(text), F.split(text, "\n", -1)).otherwise(F.array(without_fences(text)))
        each = F.transform(parts, lambda line: F.when(prose(line), _prose_pieces(line)).otherwise(let(_plain_text(line), _pieces)))
        return _or_whole(F.flatten(each), plain_text(without_fences(text)))

    return let(x, found)


def metadata(x: Text) -> Column:
    """Struct (key, value) of a ``key: value`` line, null if it isn't one."""
    return let(x, lambda v: F.when(any_of(v, (":", "：")), _metadata(v)))


def _metadata(x: Column) -> Column:
    pattern = r"^([^：:\n]{1,24})[：:]\s*([^\n]+)$"
    pair = let(inline_text(clean_claim(x)), lambda line: F.struct(strip(F.regexp_extract(line, pattern, 1)).alias("key"), strip(F.regexp_extract(line, pattern, 2)).alias("value")))
    return let(pair, lambda m: F.when((m["key"] != "") & (m["value"] != "") & ~m["key"].isin(*NOTE_LABELS) & ~any_of(F.lower(m["key"]), ("http", "file")), m))


def table_cells(x: Text) -> Column:
    return F.transform(F.split(F.btrim(strip(x), F.lit("|")), r"\|", -1), inline_text)


def table_rows(x: Text) -> Column:
    """Cells of each line with a bar, without separator rows."""
    return F.transform(F.filter(F.split(col(x), "\n"), lambda r: F.contains(r, F.lit("|")) & ~F.contains(r, F.lit("---"))), table_cells)


def list_text(x: Text) -> Column:
    return inline_text(sub(sub(strip(x), r"(?U)^\s*[-*+]\s+"), r"(?U)^\s*\d+[.)]\s+"))


def section_label(x: Text) -> Column:
    return F.coalesce(F.nullif(squeezed(strip(x)), F.lit("")), F.lit(NO_SECTION))


def section_hierarchy(parts: Column) -> Column:
    """Struct of cleaned parts, title, parent path and level."""
    shape = lambda ps: F.struct(ps.alias("parts"), F.coalesce(F.try_element_at(ps, F.lit(-1)), F.lit(NO_SECTION)).alias("title"), F.array_join(F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))), " > ").alias("parent"), F.size(ps).alias("level"))
    return let(F.transform(parts, section_label), shape)


def section_path(x: Text) -> Column:
    """The hierarchy of an ``A > B`` path."""
    return section_hierarchy(F.filter(F.transform(F.split(col(x), ">"), strip), lambda p: p != ""))


def meaningful_label(x: Column) -> Column:
    """A section label that says something: not generic, not a question, no long label with a colon."""
    return ~x.isin("", NO_SECTION, PREAMBLE) & ~x.rlike("[？?]$") & ~(x.rlike("[:：]") & (F.length(x) > 24))


def hierarchical_label(parts: Column, most: int = 3) -> Column:
    return let(F.filter(parts, meaningful_label), lambda kept: F.array_join(F.slice(kept, F.greatest(F.size(kept) - most + 1, F.lit(1)), most), " / "))


def estimated_tokens(x: Text) -> Column:
    n = F.length(strip(x))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("int")


def summary(x: Text, most: int = 120) -> Column:
    lines = F.array_join(F.filter(F.transform(F.split(col(x), "\n"), strip), lambda p: p != ""), " ")
    return shorten(lines, most)


def shorten(x: Text, most: int) -> Column:
    return let(x, lambda v: F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.substring(v, 1, most - 3)), F.lit("..."))))


def first_sentence(x: Text) -> Column:
    return let(strip(x), lambda v: F.coalesce(F.nullif(F.regexp_extract(v, r"(?Us)^(.*?[。！？.!?])(?:\s|$)", 1), F.lit("")), v))


def sentences(x: Text) -> Column:
    return F.filter(F.split(strip(x), r"(?U)(?<=[。！？.!?])\s+"), lambda s: s != "")


def as_sentence(x: Text) -> Column:
    return let(strip(x), lambda v: F.when(v.rlike("[。！？.!?]$"), v).otherwise(F.concat(v, F.lit("。"))))


def display_claim(x: Text) -> Column:
    return clean_claim(plain_text(x))


def without_frontmatter(x: Text) -> Column:
    return sub(x, r"(?Us)\A---\s*\n.*?\n---\s*(?:\n|\z)")


def headings(x: Text) -> Column:
    """Heading texts but boilerplate."""
    found = F.transform(F.regexp_extract_all(col(x), F.lit(r"(?m)^[ \t]*#+[ \t]*(\S[^\n]*)$"), F.lit(1)), strip)
    return F.filter(found, lambda h: ~F.lower(h).isin(*BOILERPLATE_HEADINGS))


def searchable_body(x: Text) -> Column:
    """Page text without front matter and boilerplate headings, as plain text."""
    lines = F.filter(F.split(without_frontmatter(x), "\n"), lambda r: ~F.lower(strip(sub(r, r"^\s*#+"))).isin(*BOILERPLATE_HEADINGS))
    return plain_text(F.array_join(lines, "\n"))


def links(x: Text) -> Column:
    """Distinct targets of links that are no images, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(x), F.lit(r"(?<!!)\[[^\]]+\]\(([^)]+)\)"), F.lit(1)), strip))


def images(x: Text) -> Column:
    """(alt, target) of each image."""
    found = F.regexp_extract_all(col(x), F.lit(r"!\[[^\]]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"), F.lit(0))
    pattern = r"!\[([^\]]*)\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("alt"), F.regexp_extract(m, pattern, 2).alias("target")))


def section_text(x: Text, heading: str) -> Column:
    """The text between a heading and the next one of the second level."""
    quoted = "\\Q" + heading + "\\E"
    return strip(F.regexp_extract(col(x), rf"(?sm)^{quoted}[ \t]*$(.*?)(?=^## |\z)", 1))


def bullets(x: Text) -> Column:
    return F.filter(F.transform(F.split(col(x), "\n"), strip), lambda r: F.startswith(r, F.lit("- ")))


def claim_reference(x: Text) -> Column:
    """The id in the first ``[`id`](…)``, null if there is none."""
    return F.nullif(F.regexp_extract(col(x), r"\[`([^`]+)`\]\([^)]*\)", 1), F.lit(""))


def page_reference(x: Text) -> Column:
    """The page id in a link to a page file."""
    return F.nullif(F.regexp_extract(col(x), r"\]\([^)]*?(page_[A-Za-z0-9_]+)[^)/]*\.md\)", 1), F.lit(""))


def without_claim_reference(x: Text) -> Column:
    return strip(sub(x, r"(?U)\s*[（(]?\[`[^`]+`\]\([^)]*\)[)）]?\s*$"))


def key(x: Text, default: str = "source") -> Column:
    """Lower-case letters and digits, everything else squeezed to underscores."""
    return F.coalesce(F.nullif(F.btrim(sub(F.lower(col(x)), r"[^\p{L}\p{N}]+", "_"), F.lit("_")), F.lit("")), F.lit(default))


def concept_title(x: Text) -> Column:
    return F.btrim(squeezed(sub(F.translate(strip(x), "|_", "  "), r"(?U)^\s*\d+[.)、:：]?\s+")), F.lit(TRIM_CLEAN))


def question_topic(x: Text) -> Column:
    """The subject of ``X 是什么`` and ``什么是 X`` labels."""
    first = lambda v, pattern: F.nullif(F.regexp_extract(v, pattern, 1), F.lit(""))
    return strip(let(strip(x), lambda v: F.coalesce(first(v, r"(?U)^(.+?)\s*是什么[？?]?$"), first(v, r"(?U)^什么是\s*(.+?)[？?]?$"), v)))


def family(canonical: Text) -> Column:
    """What stands after the first colon of a canonical id."""
    return F.nullif(sub(canonical, "^[^:]*:"), F.lit(""))


def lenient_int(x: Text, default: int) -> Column:
    return F.coalesce(F.when(strip(col(x).cast("string")).rlike(r"^\d+$"), strip(col(x).cast("string")).try_cast("int")), F.lit(default))


def lenient_float(x: Text, default: float) -> Column:
    return F.coalesce(strip(col(x).cast("string")).try_cast("double"), F.lit(default))


def grounded(text: Column, reference: Column, least_shared: int = 2, least_ratio: float = 0.35) -> Column:
    """Whether one text contains the other, or enough of the first's tokens stand in the second."""

    def test(v: Column) -> Column:
        a, b = v["a"], v["b"]
        inside = (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))
        counts = let(F.array_distinct(tokens(a)), lambda t: F.struct(F.size(F.array_intersect(t, tokens(b))).alias("shared"), F.size(t).alias("all")))
        return inside | let(counts, lambda n: (n["shared"] >= least_shared) & (n["shared"] / F.greatest(n["all"], F.lit(1)) >= least_ratio))

    return let(F.struct(normal_claim(text).alias("a"), normal_claim(reference).alias("b")), test)


def truncate_bytes(x: Text, most: int) -> Column:
    """At most so many UTF-8 bytes, cut between characters."""
    x = col(x)
    sizes = F.transform(F.sequence(F.lit(0), F.least(F.length(x), F.lit(most))), lambda n: F.struct(F.octet_length(F.substr(x, F.lit(1), n)).alias("b"), n.alias("n")))
    fit = F.array_max(F.transform(F.filter(sizes, lambda s: s["b"] <= most), lambda s: s["n"]))
    return F.when(F.octet_length(x) <= most, x).otherwise(F.substr(x, F.lit(1), fit))


def file_component(x: Text, most: int = 240, separator: str = "_") -> Column:
    """A file name of bounded bytes: longer ones end in 12 digits of their hash."""
    x = col(x)
    return F.when(F.octet_length(x) <= most, x).otherwise(F.concat(truncate_bytes(x, most - 12 - len(separator)), F.lit(separator), F.substring(F.sha2(x.cast("binary"), 256), 1, 12)))


# How an overview page introduces what it says of a page, in the order in which it is taken off.
OVERVIEW_FRAMES = (
    r"(?i)\s*\(claims=\d+\s*,\s*sources=\d+\)\s*$", r"^如果你[^，。；:：]{0,32}[，,:：]\s*", r"[。.!?]+$",
    r"^这个主题(?:会|将)?(?:解释|说明|介绍|展示|聚焦|围绕|讨论|主要讲)(?:了)?\s*", r"^如果你(?:更)?想[^，。；:：]{0,24}?(?:先读|先看|再看|接着读|优先从)\s*", r"^(?:建议|可以|可先|优先)?\s*(?:先读|先看|再看|接着读|优先从|从)\s*",
    r"(?:\s*(?:主题|页面|页))?(?:\s*(?:往下钻|继续往下钻|开始|入手|了解))?\s*$",
)


def overview_statement(x: Text) -> Column:
    """What an overview says of a page, without the phrases around it."""
    x = sub(plain_text(x), OVERVIEW_FRAMES[0])
    x = F.replace(x, F.lit("|"), F.lit(" "))
    for pattern in OVERVIEW_FRAMES[1:]:
        x = sub(x, pattern)
    return F.btrim(x, F.lit(TRIM_CLEAN))


def quoted_path(x: Text) -> Column:
    """A path as part of an URL: everything but letters, digits and ``/._-~`` in percent form."""
    quoted = F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(code), F.lit(char))
    return F.replace(quoted, F.lit("*"), F.lit("%2A"))


def relative_link(from_page: Text, to_page: Text) -> Column:
    """The link from one page's folder to another page, both as paths from the same root."""
    parts = F.struct(F.filter(F.split(sub(from_page, "[^/]*$"), "/"), lambda p: p != "").alias("a"), F.filter(F.split(col(to_page), "/"), lambda p: p != "").alias("b"))

    def link(v: Column) -> Column:
        most = F.least(F.size(v["a"]), F.size(v["b"]))
        places = F.filter(F.sequence(F.lit(0), most), lambda k: F.slice(v["a"], 1, k) == F.slice(v["b"], 1, k))
        return let(F.array_max(places), lambda k: quoted_path(F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(v["a"]) - k), F.slice(v["b"], k + 1, F.size(v["b"]))), "/")))

    return let(parts, link)
