"""Terms, similarity of texts, markers, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: phrases that deny each other, looked for in lower-case text between spaces
OPPOSITES = (
    (" enabled ", " disabled "), (" allow ", " deny "), (" true ", " false "), (" required ", " optional "), (" must ", " must not "),
    (" should ", " should not "), (" can ", " cannot "), ("支持", "不支持"), ("允许", "禁止"), ("必须", "不能"),
)
# fixed values: the same for claims, looked for in lower-case text as it is
CLAIM_OPPOSITES = (
    (" enabled", " disabled"), (" allow", " deny"), (" allowed", " forbidden"), (" true", " false"), (" required", " optional"), (" must ", " must not "),
    (" should ", " should not "), (" can ", " cannot "), (" is ", " is not "), ("支持", "不支持"), ("允许", "禁止"), ("必须", "不能"),
)
# fixed values: phrases that try to take over a prompt
INJECTIONS = ("ignore previous instructions", "system prompt:", "<|im_start|>")
# fixed values: words without weight in a query
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "what", "when", "where", "how", "why", "一个", "这个", "那个", "什么", "如何", "怎么", "以及", "或者")
# fixed values: beginnings of keys that give access
KEY_STARTS = ("sk-", "pk-", "ghp_", "github_pat_")
EDGE = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"


def terms(text: Column, least_bytes: int = 2, keep: str = "") -> Column:
    """Distinct lower-case runs of letters and digits of at least ``least_bytes`` bytes; ``keep``: further characters that belong to a term."""
    parts = F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{keep}]+")
    return F.array_distinct(F.filter(parts, lambda t: F.octet_length(t) >= least_bytes))


def overlap(query: Column, other: Column) -> Column:
    """Share of the query's terms that the other has; 0 without terms."""
    n = F.size(query)
    return F.when(n > 0, F.size(F.array_intersect(query, other)) / n).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Common by all distinct elements; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    whole = F.size(F.array_union(a, b))
    return F.when(whole > 0, common / whole).otherwise(0.0)


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def important_terms(text: Column, n: int | None = None) -> Column:
    """Sorted distinct terms of three bytes or more (``_`` and ``-`` belong to them) that are no stop words."""
    t = F.array_sort(F.array_except(terms(text, 3, "_-"), F.array(*[F.lit(w) for w in STOP_WORDS])))
    return F.slice(t, 1, n) if n else t


def _opposed(x: Column, y: Column, pairs: tuple) -> Column:
    out = F.lit(False)
    for p, q in pairs:
        out = out | (F.contains(x, F.lit(p)) & F.contains(y, F.lit(q))) | (F.contains(x, F.lit(q)) & F.contains(y, F.lit(p)))
    return out


def contradicts(a: Column, b: Column) -> Column:
    """Whether one text has one side of a pair of opposites and the other text the other side."""
    pad = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return _opposed(pad(a), pad(b), OPPOSITES)


def claims_contradict(a: Column, b: Column) -> Column:
    """The same for claims, with more pairs and without padding."""
    return _opposed(F.lower(a), F.lower(b), CLAIM_OPPOSITES)


def repeated_ratio(text: Column) -> Column:
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")
    return F.when(F.size(w) > 0, 1 - F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_email(token: Column) -> Column:
    """Something before the first @, and behind it three bytes or more with a dot."""
    at = F.instr(token, "@")
    domain = F.substring(token, at + 1, F.length(token))
    return (at > 1) & F.contains(domain, F.lit(".")) & (F.octet_length(domain) >= 3)


def is_key(token: Column) -> Column:
    """A known beginning, or 24 or more letters, digits, ``_`` and ``-`` and nothing else."""
    known = F.lit(False)
    for k in KEY_STARTS:
        known = known | F.startswith(F.lower(token), F.lit(k))
    return known | token.rlike(r"^[A-Za-z0-9_-]{24,}$")


def is_long_id(token: Column) -> Column:
    """Eleven or more digits, with nothing but signs of phone numbers between them."""
    return token.rlike(r"^[-0-9+() ]+$") & (F.length(F.regexp_replace(token, "[^0-9]", "")) >= 11)


def _has_key_block(text: Column) -> Column:
    return F.contains(text, F.lit("-----BEGIN")) & F.contains(text, F.lit("PRIVATE KEY-----"))


def redact(text: Column) -> Column:
    """Addresses, keys and long ids give way to markers, word by word, inside the punctuation around them; words end up one space apart. A text with a private key is one marker."""

    def one(token: Column) -> Column:
        bare = F.regexp_replace(token, EDGE, "")
        mark = F.when(is_email(bare), "[REDACTED_EMAIL]").when(is_key(bare), "[REDACTED_SECRET]").when(is_long_id(bare), "[REDACTED_ID]")
        return F.when(mark.isNull(), token).otherwise(F.replace(token, bare, mark))

    joined = F.array_join(F.transform(_tokens(text), one), " ")
    return F.when(_has_key_block(joined), "[REDACTED_PRIVATE_KEY]").otherwise(joined)


def sensitive_counts(text: Column) -> dict[str, Column]:
    """How many words are addresses, keys (no addresses) and long ids (neither), and texts with a private key; 0 for null."""
    bare = F.transform(_tokens(text), lambda t: F.regexp_replace(t, EDGE, ""))
    count = lambda test: F.coalesce(F.size(F.filter(bare, test)), F.lit(0))
    return {
        "email": F.when(text.isNull(), 0).otherwise(count(is_email)),
        "api_key": F.when(text.isNull(), 0).otherwise(count(lambda t: is_key(t) & ~is_email(t))),
        "long_id": F.when(text.isNull(), 0).otherwise(count(lambda t: is_long_id(t) & ~is_key(t) & ~is_email(t))),
        "private_key": F.coalesce(_has_key_block(text), F.lit(False)).cast("int"),
    }


def slug(text: Column, n: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, n)


def sanitize_segment(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def key_values(text: Column) -> Column:
    """``k: v`` or ``k = v`` pairs between commas, semicolons and line ends, as a map; the last wins."""
    pairs = F.filter(F.split(text, r"[,;\n]"), lambda p: p.rlike(r"[:=]"))
    at = lambda p, i: F.trim(F.get(F.split(p, r"[:=]", 2), F.lit(i)))
    kept = F.filter(F.transform(pairs, lambda p: F.struct(at(p, 0).alias("key"), at(p, 1).alias("value"))), lambda e: e["key"] != "")
    return F.aggregate(kept, F.create_map().cast("map<string,string>"), lambda m, e: F.map_from_entries(F.concat(F.filter(F.map_entries(m), lambda x: x["key"] != e["key"]), F.array(e))))


def blocked(text: Column) -> Column:
    """Verdict on a text to be stored: injection, empty (null too), sensitive (see ``redact``), or clean."""
    hit = F.lit(False)
    for p in INJECTIONS:
        hit = hit | F.contains(F.lower(text), F.lit(p))
    found = sum(sensitive_counts(text).values(), F.lit(0))
    return F.when(hit, "injection").when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").when(found > 0, "sensitive").otherwise("clean")


def approx_tokens(text: Column, floor: int = 0) -> Column:
    """A quarter of the characters, rounded up, where no tokenizer is at hand."""
    return F.greatest(F.lit(floor), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4))
