"""Personal data by fixed patterns and by bootstrapped contexts, in DataFrame functions only.

The patterns find seeds: e-mail and IP addresses, card and phone numbers. Seeds, every other token with an @ or enough digits, and runs of number tokens that single spaces join, are
instances; the two words before one, and the word before with the word after it (however long), are its lexical patterns. What is discovered is therefore a whole token, less its outer
punctuation, or such a run of numbers; names and other words never are. Pattern and instance form a bipartite graph over all rows. In each round a
pattern's confidence in a kind is the share of its distinct instances that are known to be of the kind, and an instance's is the noisy-or of its
patterns; instances that reach `CONFIDENT` become known, and the next round starts from them. A pattern needs `SUPPORT` distinct known
instances, so that a context that only chance repeats discovers nothing.

Null and empty texts have no spans. Rows are answered one by one, repeated or null ids included; other columns are kept by mask() and ignored otherwise.
Positions are code points; ends are exclusive. Arrays are walked in chunks and texts in blocks, so that time is linear in a text and its tokens.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no start is tried twice; a run of 13 to 19 digits stands for the card pattern with its digit count.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
OCTETS = rf"^{_PART}(?:\.{_PART}){{3}}$"

ROUNDS = 3
SUPPORT = 8
CONFIDENT = 0.9
LEAST_DIGITS = 5  # of a discovered identifier without an @
TOKEN = (
    rf"(?<!\S)(?:(?=(?:[ ().-]*+[0-9]){{{LEAST_DIGITS}}})\(?+[0-9][0-9().-]*+(?:\x20\(?+[0-9][0-9().-]*+)*+(?=[,;:!?\"']*+(?:\s|\z))"
    rf"|(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){{{LEAST_DIGITS}}})\S++)"
)
CHUNK = 64  # elements of an array that are walked before they are set aside
BLOCK = 2048  # code points of a text from which a part is cut

_SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"
_LAST_WORDS = r"^\s*+(?:\S++\s++){0,2}+\S*+"  # of a text read backwards: its last two words and what is left of a third


def walk(items: Column, state: Column, kind: str, step) -> Column:
    """All that `step` (state, item) -> (state, array of `kind`) gives for the items in turn. Results are set aside by chunks, as an array that grows by one at a time is copied each time."""
    none = F.expr(f"cast(array() as array<{kind}>)")
    # the array of one array names `items`, which would be worked out again for each chunk otherwise
    chunks = F.element_at(F.transform(F.array(items), lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, CHUNK))), 1)

    def one(acc: Column, x: Column) -> Column:
        now, out = step(acc["state"], x)
        return F.struct(now.alias("state"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        done = F.aggregate(c, F.struct(acc["state"].alias("state"), none.alias("out")), one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))
        return done

    return F.aggregate(chunks, F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), chunk, lambda acc: F.flatten(acc["out"]))


def matches(text: Column, pattern: str, there: Column) -> Column:
    """All matches with their code-point spans and the words around them: the pieces between matches give both. `there` rules texts out cheaply."""
    p = F.lit(pattern)
    found, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1)
    # of each match: the piece before it, the match, and the text from there on as far as the end of the piece after the next match
    near = F.arrays_zip(F.slice(pieces, 1, F.size(found)).alias("p"), found.alias("m"), F.slice(pieces, 2, F.size(found)).alias("q"), F.concat(F.slice(found, 2, F.size(found)), F.array(F.lit(""))).alias("n"), F.concat(F.slice(pieces, 3, F.size(found)), F.array(F.lit(""))).alias("r"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        left = F.concat(state["tail"], x["p"])
        tail = F.reverse(F.regexp_extract(F.reverse(F.concat(left, x["m"])), _LAST_WORDS, 0))
        before = F.reverse(F.regexp_extract(F.reverse(left), r"^\s++(\S++\s++\S++)", 1))
        after = F.regexp_extract(F.concat(x["q"], x["n"], x["r"]), r"^\s++(\S++)", 1)
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), tail.alias("tail")), F.array(one)

    walked = walk(near, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), _SPAN, step)
    return F.when(there & F.regexp_like(text, p), walked).otherwise(F.expr(f"cast(array() as array<{_SPAN}>)"))


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(m, F.lit(OCTETS))
    if kind == "card":
        return F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", ""))
    if kind == "phone":
        return _digits(m).between(9, 15)
    return F.lit(True)


def _kind_spans(kind: str, found: Column) -> Column:
    return F.filter(found, lambda s: _passes(kind, s["match"]))


def _tagged(tag: Column):
    return lambda s: F.struct(tag.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after"))


def annotate(docs: DataFrame, *keep: str) -> DataFrame:
    """key, doc_id, a span array for each kind, and `tokens` (spans of all kinds, and tokens that may be identifiers, with their contexts), for each row; `keep` names further columns."""
    text = F.coalesce("text", F.lit(""))
    digit = F.regexp_like(text, F.lit("[0-9]"))
    there = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    out = docs.withColumn("text", text) if "text" in keep else docs
    spans = [_kind_spans(k, matches(text, PATTERNS[k], there[k])).alias(k) for k in KINDS]
    found = out.select(F.monotonically_increasing_id().alias("key"), "doc_id", *keep, *spans, matches(text, TOKEN, digit | there["email"]).alias("loose"))
    tokens = F.concat(*[F.transform(k, _tagged(F.lit(k))) for k in KINDS], F.transform("loose", _tagged(F.lit(None).cast("string"))))
    plain = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k)
    return found.select("key", "doc_id", *keep, *map(plain, KINDS), tokens.alias("tokens"))


def discover(annotated: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """key, kind, start, end of the identifiers that only their contexts give away."""
    scratch = Scratch(annotated.sparkSession)
    token = annotated.where(F.size("tokens") > 0).select("key", F.explode("tokens").alias("t")).select("key", "t.*")
    # tokens that overlap a span of the patterns go: spans that start no later by the furthest end so far, later ones by the next start
    up = Window.partitionBy("key").orderBy("start", F.col("kind").isNull(), "end")
    down = Window.partitionBy("key").orderBy(F.col("start").desc(), F.col("kind").isNull().desc(), F.col("end").desc())
    seed = F.col("kind").isNotNull()
    reach = F.max(F.when(seed, F.col("end"))).over(up.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(seed, F.col("start"))).over(down.rowsBetween(Window.unboundedPreceding, -1))
    token = token.withColumn("reach", reach).withColumn("ahead", ahead).where(seed | ((F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end")))).drop("reach", "ahead")
    words = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))
    token = token.withColumn("before", words(F.col("before"))).withColumn("after", words(F.col("after")))
    lead, trail = F.regexp_extract("match", r"^[\p{P}&&[^+@]]+", 0), F.regexp_extract("match", r"[\p{P}&&[^@]]+$", 0)
    instance = F.lower(F.regexp_replace("match", r"^[\p{P}&&[^+@]]+|[\p{P}&&[^@]]+$", ""))
    last = F.regexp_extract("before", r"(\S+)$", 1)
    rows = token.withColumn("instance", instance).where("instance <> ''").withColumn("start", F.col("start") + F.when(seed, 0).otherwise(F.length(lead))).withColumn("end", F.col("end") - F.when(seed, 0).otherwise(F.length(trail)))
    rows = rows.withColumn("patterns", F.array_compact(F.array(F.when(F.col("before") != "", F.concat(F.col("before"), F.lit(" _"))), F.when((last != "") & (F.col("after") != ""), F.concat(last, F.lit(" _ "), F.col("after"))))))
    rows = scratch.keep(rows.select("key", "start", "end", "instance", "kind", "patterns"), "instances")
    # each pair of pattern and instance once; a context that a third of all rows share shrinks to its distinct instances before any shuffle
    edges = scratch.keep(rows.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.max("kind").alias("seed")), "graph")
    known = edges.where("seed is not null").groupBy("instance").agg(F.max("seed").alias("kind"))
    for _ in range(rounds):
        told = edges.join(known, "instance", "left")
        pattern = told.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
        best = reduce(lambda a, b: F.greatest(a, b), [F.struct(F.col(k).alias("hits"), F.lit(k).alias("kind")) for k in KINDS])
        pattern = pattern.withColumn("best", best).select("pattern", F.col("best.kind").alias("kind"), F.col("best.hits").alias("hits"), (F.col("best.hits") / F.col("n")).alias("confidence"))
        good = pattern.where((F.col("hits") >= support) & (F.col("confidence") >= confident / 2))
        # noisy-or over an instance's patterns of a kind; a pattern counts in full only in as far as its support is more than chance
        weight = F.col("confidence") * (1 - 1 / F.log2(F.col("hits") + 1))
        scored = edges.where("seed is null").join(good, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - weight, F.lit(1e-6)))))).alias("score"))
        fresh = scored.where(F.col("score") >= confident).groupBy("instance").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        known = scratch.keep(known.unionByName(fresh.join(known, "instance", "left_anti")), "known")
    found = rows.where("kind is null").drop("kind").join(known, "instance").select("key", "kind", "start", "end")
    return found


def _all(annotated: DataFrame) -> DataFrame:
    """annotated rows with `found`, the discovered spans as an array."""
    found = discover(annotated).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    return annotated.join(found, "key", "left")


def _listed() -> tuple[Column, Column]:
    """Base spans and all spans as arrays of (kind's place, start, end), in that order."""
    named = lambda i, s: F.struct(i.alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    of = lambda i: lambda s: named(F.lit(i), s)
    base = F.concat(*[F.transform(k, of(i)) for i, k in enumerate(KINDS)])
    place = lambda c: (F.array_position(F.array(*map(F.lit, KINDS)), c) - 1).cast("int")
    added = F.transform(F.coalesce("found", F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")), lambda s: named(place(s["kind"]), s))
    return F.array_sort(base), F.array_sort(F.concat(base, added))  # what is added never overlaps a base span


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row of `docs`."""
    rows = _all(Scratch(docs.sparkSession).keep(annotate(docs), "annotated"))
    base, spans = _listed()
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with each span in `text` replaced by its kind in brackets; of overlapping spans the first is replaced. Null texts stay null."""
    names = {f"keep_{i}": c for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # columns may be called as those used here
    inner = docs.select("doc_id", "text", F.col("text").isNull().alias("was_null"), *(docs[c].alias(k) for k, c in names.items()))
    rows = _all(Scratch(docs.sparkSession).keep(annotate(inner, "text", "was_null", *names), "annotated"))
    _, spans = _listed()
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # of overlapping spans the first: what is left of the text goes from `at` to `start`, then comes the kind's mark
    step = lambda at, s: (
        F.greatest(at, F.when(s["start"] >= at, s["end"]).otherwise(at)),
        F.when(s["start"] >= at, F.array(F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))).otherwise(F.expr("cast(array() as array<struct<at:int,start:int,kind:int>>)")),
    )
    last = F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(-1).alias("kind"))
    parts = walk(F.concat(by_start, F.array(last)), F.lit(0), "struct<at:int,start:int,kind:int>", step)
    blocks = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))
    begin = lambda s: F.floor(s["at"] / BLOCK).cast("int")
    some = lambda a, s: F.array_join(F.slice(a, begin(s) + 1, F.floor(s["start"] / BLOCK).cast("int") - begin(s) + 1), "")
    mark = lambda s: F.when(s["kind"] >= 0, F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))).otherwise("")
    part = lambda a: lambda s: F.concat(F.substring(some(a, s), s["at"] % BLOCK + 1, s["start"] - s["at"]), mark(s))
    # the array of one array names the blocks, which would be cut again for each part otherwise
    cut = F.element_at(F.transform(F.array(blocks), lambda a: F.array_join(F.transform(parts, part(a)), "")), 1)
    rows = rows.withColumn("spans", spans)
    text = F.when(F.col("was_null"), F.lit(None).cast("string")).when(F.size("spans") > 0, cut).otherwise(F.col("text"))
    return rows.select("doc_id", text.alias("text"), *(F.col(k).alias(c) for k, c in names.items())).select(docs.columns)
