"""Personal data by bootstrapped contextual extraction.

Fixed base rules find e-mail addresses, IP addresses, card and phone numbers in
every whole text. They seed a bootstrap: the words around an identifier are its
lexical patterns (``NEAR`` characters on either side), and patterns and identifiers form a
graph. Spark scores it in rounds: a pattern is as reliable for a kind as that kind's share
of its believed identifiers, and of a part of those that are not believed: each counts
the less the more the pattern is known to find (``DOUBT``), so that what it could discover
does not speak against a pattern with much evidence. An identifier that no rule knows is
believed as far as its reliable patterns say (noisy or). Identifiers that are
believed count as evidence in the next round. At the end the reliable patterns add
the spans of unseen identifiers to those of the base rules.

Defined results: a null or empty text has no spans; repeated rows get the same
spans each, and repeated identifiers count once; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import itertools
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Reliable patterns have this much evidence and this share of it for one kind;
#: believed identifiers reach this score; the graph is scored in so many rounds.
MIN_EVIDENCE, MIN_RELIABLE, MIN_BELIEF, ROUNDS = 3.0, 0.8, 0.8, 3
#: Of a pattern's unbelieved identifiers this many, divided by its evidence, count against
#: it; at most one and at least LEAST_DOUBT of each.
DOUBT, LEAST_DOUBT = 8.0, 0.05
NEAR = 80
#: An identifier that no rule knows has at most MAX_TOKEN characters and at least so many digits, or an at sign.
MIN_DIGITS, MAX_TOKEN = 4, 64

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_TRIM = "\"'()[]{}<>.,;:!?=*|"
SPANS = "array<struct<start: int, kind: int, end: int>>"
FOUND = (f"rid long, doc_id long, base {SPANS}, "
         "seen array<struct<start: int, end: int, kind: int, item: bigint, patterns: array<bigint>>>")


def _emails(text: str):
    """Spans as the pattern gives them, leftmost first: a local part reaches back
    from its at sign to the last match or to a character outside its class."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    if text.count(".") > 2:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def _word(token: str) -> str:
    return re.sub("[0-9]", "0", token.strip(_TRIM).lower())


def _context(text: str, start: int, end: int) -> list[int]:
    """Pattern keys of the words around a span: two before, one before and one
    after, and two after."""
    before = text[max(0, start - NEAR):start].split()[-2:]
    after = text[end:end + NEAR].split()[:2]
    left, right = [_word(w) for w in before], [_word(w) for w in after]
    out = []
    if len(left) == 2:
        out.append(_key("ll", *left))
    if left and right:
        out.append(_key("lr", left[-1], right[0]))
    if len(right) == 2:
        out.append(_key("rr", *right))
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base identifiers and other identifier-like tokens with their patterns; kind
    is -1 where no rule knows the token."""
    out = [{"start": a, "end": b, "kind": k, "item": _key("item", text[a:b].lower()), "patterns": _context(text, a, b)}
           for a, k, b in base]
    # spans by start, with the furthest end up to each: overlaps by bisection
    starts, ends = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    at = 0
    for m in _DIGITS.finditer(text):
        if m.start() < at:
            continue
        a, b = m.start(), m.end()
        while a > at and not text[a - 1] in " \t\n\x0b\x0c\r" and m.end() - a < MAX_TOKEN:
            a -= 1
        t = _TOKEN.match(text, a, min(len(text), a + MAX_TOKEN + 1))
        if t is None:
            continue
        at = b = t.end()
        token = t[0]
        a += len(token) - len(token.lstrip(_TRIM))
        token = token.strip(_TRIM)
        b = a + len(token)
        if len(token) > MAX_TOKEN or ("@" not in token and sum(c in "0123456789" for c in token) < MIN_DIGITS):
            continue
        before = bisect.bisect_left(starts, b)
        if before and ends[before - 1] > a:
            continue
        out.append({"start": a, "end": b, "kind": -1, "item": _key("item", token.lower()), "patterns": _context(text, a, b)})
    return out


_DIGITS = re.compile("[0-9@]")


def _find_rows(batches, schema: pa.Schema):
    for batch in batches:
        base, seen = [], []
        for t in batch.column(2):
            text = t.as_py()
            spans = base_spans(text)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            seen.append(occurrences(text, spans))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(base, schema.field(2).type), pa.array(seen, schema.field(3).type)],
            schema=schema)


def find(docs: DataFrame) -> DataFrame:
    """rid (the row in ``docs``), doc_id, base spans and occurrences."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("item", pa.int64()),
                      ("patterns", pa.list_(pa.int64()))])
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(span)), ("seen", pa.list_(item))])
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(
        lambda batches: _find_rows(batches, schema), FOUND)


def bootstrap(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores the pattern-identifier graph of ``seen`` (kind, item, patterns).
    Returns reliable patterns (pattern, kind, reliable) and believed identifiers
    (item, kind, belief)."""
    edges = materialize(seen.select("kind", "item", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    links = edges.select("item", "pattern").distinct()
    size = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("items"))
    seeds = edges.filter("kind >= 0").select("item", "kind").distinct()
    unknown = links.join(seeds.select("item").distinct(), "item", "left_anti")
    belief = seeds.withColumn("belief", F.lit(1.0))
    for k in range(rounds):
        evidence = links.join(belief, "item").groupBy("pattern", "kind").agg(
            F.sum("belief").alias("evidence"), F.count(F.lit(1)).alias("n"))
        known = evidence.groupBy("pattern").agg(F.sum("evidence").alias("known"), F.sum("n").alias("met"))
        doubt = F.greatest(F.least(F.lit(1.0), F.lit(DOUBT) / F.col("evidence")), F.lit(LEAST_DOUBT))
        # an identifier of two kinds is met twice
        against = F.greatest(F.col("items") - F.col("met"), F.lit(0)) * doubt
        patterns = (evidence.filter(F.col("evidence") >= MIN_EVIDENCE).join(known, "pattern").join(size, "pattern")
                    .withColumn("reliable", F.col("evidence") / (F.col("known") + against + 0.5))
                    .filter(F.col("reliable") >= MIN_RELIABLE).select("pattern", "kind", "reliable"))
        patterns = materialize(patterns, f"pii-patterns-{k}")
        scored = (unknown.join(patterns, "pattern").groupBy("item", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1.0 - F.col("reliable"))))).alias("belief")))
        best = scored.groupBy("item").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("b"))
        found = materialize(best.select("item", (-F.col("b.k")).alias("kind"), "b.belief").filter(
            F.col("belief") >= MIN_BELIEF), f"pii-items-{k}")
        belief = seeds.withColumn("belief", F.lit(1.0)).unionByName(found)
    return patterns, found


def extract(docs: DataFrame) -> DataFrame:
    """rid, doc_id, base and all spans (start, kind, end) of every row."""
    table = materialize(find(docs), "pii-found")
    seen = table.filter(F.size("seen") > 0).select("rid", F.explode("seen").alias("o")).select("rid", "o.*")
    patterns, found = bootstrap(seen)
    unseen = seen.filter("kind < 0").drop("kind").join(found.select("item", "kind"), "item")
    backed = (unseen.select("rid", "start", "end", "kind", F.explode("patterns").alias("pattern"))
              .join(patterns.select("pattern", "kind"), ["pattern", "kind"]).select("rid", "start", "kind", "end").distinct())
    more = backed.groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    return table.select("rid", "doc_id", "base").join(more, "rid", "left").select("rid", "doc_id", "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans and all spans."""
    out = extract(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _masked(text: str, spans: list[dict]) -> str:
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def masked_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind; ``n_chars``, where there is
    such a column, follows the text. ``docs`` must be a table."""
    found = extract(docs).filter(F.size("spans") > 0).select("rid", "spans")

    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_masked(t.as_py(), s.as_py()) for t, s in zip(text, spans)], pa.string())

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct("*").alias("row"))
    both = rows.join(found, "rid", "left")
    kept = both.filter("spans is null").select("row.*")
    mask = F.arrow_udf(run, "string")
    masked = both.filter("spans is not null").withColumn("masked", mask("row.text", "spans"))
    cols = [F.col("masked").alias(c) if c == "text" else F.length("masked").cast(t).alias(c) if c == "n_chars"
            else F.col("row").getField(c).alias(c) for c, t in docs.dtypes]
    return kept.unionByName(masked.select(*cols))
