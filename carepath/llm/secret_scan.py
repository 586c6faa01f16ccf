"""Secret scan with multipart credential linking.

Strong patterns report by themselves: an assignment to a secret's name, an access
identifier, a long hexadecimal run. Weak parts do not: a mail address or an
assignment to an account's name (identifier), a mixed token of 20 characters and
more (secret), an address with a scheme (endpoint). A weak part is reported only
if a complementary part, weak or strong, lies in its scope: within ``SCOPE`` code
points of it in the same text. An identifier needs a secret, an endpoint
needs a secret, a secret needs an identifier or an endpoint.

Linking is an interval join: parts are put into bins of ``SCOPE`` code points, a
weak part looks into the bins its scope touches, and the distance decides. Parts
of one kind do not overlap, so a bin holds a bounded number of them and the join
grows with the number of parts. Parts are keyed by the digest of the text:
copies are linked once, however many rows share the text.

Only DataFrame functions: the places of a pattern's matches are the running
lengths of what ``split`` leaves between them and of the matches themselves. Patterns
are flat and read a run once, and running sums grow in blocks, so time is in
proportion to a text's length and matches, for a run or a number of matches of any size.

Defined cases: a null text is empty; without spans the lists are empty strings;
rows alike in text get alike spans; an empty table gives an empty table; a null
id is carried; only the id and text are read (``redact`` carries all columns).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import small_side, staged

SCOPE = 200
MARKER = "[secret]"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = ("(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
          + _SET + "([A-Za-z0-9+/_.=-]+)")
#: The shortest match is part of these patterns: their runs are maximal, so no other match is hidden by a short one.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ACCOUNT = ("(" + "|".join(map(_any_case, ("user_?name", "user_?id", "login", "client_?id", "account")))
           + ")" + _SET + "([A-Za-z0-9@._-]{3,})")
#: Tried only where a run begins and without going back into it, so a long run is read once; trailing dots are not part of it.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]++"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
#: A scheme has a bounded length, so a long run costs a bounded number of steps per character.
ENDPOINT = r"""[a-z][a-z0-9+.-]{0,30}://[^\x00-\x20"'<>]++"""
#: Order of kinds at one start.
KINDS = ("assign", "access", "hex", "account", "mail", "token", "endpoint")
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "mail": "identifier",
        "token": "secret", "endpoint": "endpoint"}
_SPANS = "array<struct<start:int,rank:int,end:int>>"


#: Items of one block in ``_running``.
BLOCK = 256


def _none() -> Column:
    return F.array().cast(_SPANS)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, whatever the number of places in lambdas that use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(items: Column, value, op, start, emit) -> Column:
    """``emit(item, before)`` for each item, ``before`` being ``op`` over ``start`` and the values of the items before it.

    A list that grows by one entry is copied each time, so items are dealt into blocks: lists grow only within a
    block and over the blocks' totals, and the cost is in proportion to the items for any text.
    """
    def by_blocks(xs: Column) -> Column:
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, BLOCK)), joined)

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(start), lambda acc, x: op(acc, value(x))))
        offsets = F.aggregate(totals, F.array(F.lit(start)),
                              lambda acc, t: F.concat(acc, F.array(op(F.element_at(acc, -1), t))))
        return _let(offsets, lambda at: F.flatten(F.transform(blocks, lambda block, b: one(block, F.get(at, b)))))

    def one(block: Column, before: Column) -> Column:
        first = F.struct(before.alias("at"), F.slice(F.transform(block, lambda x: emit(x, before)), 1, 0).alias("out"))
        return F.aggregate(block, first, lambda acc, x: F.struct(
            op(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(emit(x, acc["at"]))).alias("out")),
            lambda acc: acc["out"])

    return _let(items, by_blocks)


def _spans(text: Column, kind: str, pattern: str, good=None, gate: Column | None = None, trim: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches for which ``good(match)`` holds, without trailing ``trim`` characters."""
    def measured(found: Column) -> Column:
        return F.transform(found["matches"], lambda match, i: F.struct(
            F.length(F.get(found["parts"], i)).alias("gap"), F.length(match).alias("whole"),
            F.length(F.rtrim(match, F.lit(trim)) if trim else match).alias("own"),
            (good(match) if good is not None else F.lit(True)).alias("good")))

    def placed(items: Column) -> Column:
        return _running(items, lambda x: x["gap"] + x["whole"], lambda a, b: a + b, 0, lambda x, before: F.struct(
            (before + x["gap"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
            (before + x["gap"] + x["own"]).alias("end"), x["good"].alias("good")))

    parts = F.split(text, pattern, -1)
    found = F.struct(parts.alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    spans = _let(found, lambda x: F.when(F.size(x["matches"]) > 0, F.transform(
        F.filter(placed(measured(x)), lambda s: s["good"]),
        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))).otherwise(_none()))
    return F.when(gate, spans).otherwise(_none()) if gate is not None else spans


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 8


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]")


def base_spans(text: Column) -> Column:
    return F.concat(_spans(text, "assign", ASSIGN, _long_enough), _spans(text, "access", ACCESS, gate=text.contains("AKIA")),
                    _spans(text, "hex", HEX))


def weak_spans(text: Column) -> Column:
    return F.concat(
        _spans(text, "account", ACCOUNT), _spans(text, "mail", MAIL, gate=text.contains("@"), trim="."),
        _spans(text, "token", TOKEN, _mixed), _spans(text, "endpoint", ENDPOINT, gate=text.contains("://")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, weak, key): strong spans, weak parts and, where weak parts could be linked, the text's digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), base_spans(text).alias("base"),
                        weak_spans(text).alias("weak"))
    every = F.concat("base", "weak")
    open_ = (F.size("weak") > 0) & _has_role_of(every, "secret") & (
        _has_role_of(every, "identifier") | _has_role_of(every, "endpoint"))
    return found.select("doc_id", "base", "weak", F.when(open_, F.md5("t")).alias("key"))


def _has_role_of(spans: Column, role: str) -> Column:
    ranks = [KINDS.index(k) for k in KINDS if ROLE[k] == role]
    return F.exists(spans, lambda s: s["rank"].isin(ranks))


def _role(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), rank + 1)


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, linked): the weak parts of a text that have a complement in their scope."""
    texts = scanned.where("key is not null").groupBy("key").agg(F.first(F.struct("base", "weak")).alias("p")).select(
        "key", "p.base", "p.weak")
    part = lambda c: texts.select("key", F.explode(c).alias("s")).select(
        "key", "s.start", "s.rank", "s.end", _role(F.col("s.rank")).alias("role"))
    strong, weak = part("base"), part("weak")
    wants = (weak.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start") - scope) / scope),
                                                         F.floor((F.col("end") + scope) / scope))))
             .select("key", "bin", F.col("start").alias("a"), F.col("rank").alias("r"), F.col("end").alias("b"),
                     F.col("role").alias("need")))
    offers = strong.unionByName(weak).withColumn(
        "bin", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))))
    near = (F.col("start") <= F.col("b") + scope) & (F.col("end") >= F.col("a") - scope)
    apart = (F.col("start") >= F.col("b")) | (F.col("end") <= F.col("a"))
    fits = F.when(F.col("need") == "secret", F.col("role") != "secret").otherwise(F.col("role") == "secret")
    hits = wants.join(offers, ["key", "bin"]).where(near & apart & fits).select("key", "a", "r", "b").distinct()
    return hits.groupBy("key").agg(F.sort_array(F.collect_list(
        F.struct(F.col("a").alias("start"), F.col("r").alias("rank"), F.col("b").alias("end")))).alias("linked"))


def _clear_of(spans: Column, base: Column) -> Column:
    """Linked parts that share no character with a strong span, which reports them already.

    Both kinds are put in order; a part is hit if a strong span before it ends after its start, or one after it
    starts before its end.
    """
    def flagged(xs: Column, strong: bool) -> Column:
        return F.transform(xs, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
                                                  F.lit(strong).alias("strong"), F.lit(False).alias("hit")))

    def passed(xs: Column, value, op, start: int, hits) -> Column:
        return _running(xs, value, op, start, lambda x, before: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["strong"].alias("strong"),
            (x["hit"] | hits(x, before)).alias("hit")))

    far = 2 ** 31 - 1
    every = F.array_sort(F.concat(flagged(base, True), flagged(spans, False)))
    ahead = passed(every, lambda x: F.when(x["strong"], x["end"]).otherwise(-1), F.greatest, -1,
                   lambda x, before: before > x["start"])
    back = passed(F.reverse(ahead), lambda x: F.when(x["strong"], x["start"]).otherwise(far), F.least, far,
                  lambda x, before: before < x["end"])
    clear = F.transform(F.filter(back, lambda x: ~x["strong"] & ~x["hit"]),
                        lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return F.when(F.size(spans) > 0, F.reverse(clear)).otherwise(_none())


def find(docs: DataFrame, *, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for every row: strong spans and all reported ones, ordered by start and kind."""
    scanned = staged(scan(docs, id_col, text_col), "secrets")
    return _joined(scanned, linked(scanned, scope)).select("doc_id", F.sort_array("base").alias("base"),
                                                           F.sort_array("spans").alias("spans"))


def _joined(scanned: DataFrame, found: DataFrame) -> DataFrame:
    more = F.coalesce("linked", _none())
    open_ = scanned.where("key is not null").join(found, "key", "left").withColumn(
        "spans", F.concat("base", _clear_of(more, F.col("base")))).drop("linked")
    return scanned.where("key is null").withColumn("spans", F.col("base")).unionByName(open_)


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def report(docs: DataFrame) -> DataFrame:
    return find(docs).select("doc_id", _count("assign").alias("n_assign"), _count("access").alias("n_access"),
                             _count("hex").alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"),
                             _listed("spans").alias("spans"))


def redact(docs: DataFrame, *, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text",
           marker: str = MARKER) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``marker``; a column ``n_chars`` follows the text."""
    scanned = scan(docs, id_col, text_col)
    found = staged(linked(staged(scanned, "secrets"), scope), "linked").select(
        F.col("key").alias("_key"), F.col("linked").alias("_linked"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("_base", base_spans(text)).join(small_side(found, 256), F.md5(text) == F.col("_key"), "left")
    more = F.coalesce("_linked", _none())
    clean = _let(F.sort_array(F.concat("_base", _clear_of(more, F.col("_base")))), lambda spans: _without(text, spans, marker))
    hit = F.size("_base") + F.size(more) > 0
    done = base.withColumn("_clean", F.when(hit, clean).otherwise(F.col(text_col)))
    new = {text_col: F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("_clean")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def _without(text: Column, spans: Column, marker: str) -> Column:
    """``text`` with ``marker`` in place of each stretch that the ordered ``spans`` (one at least) cover; overlapping spans are one."""
    reach = _running(spans, lambda x: x["end"], F.greatest, -1, lambda x, before: F.struct(
        x["start"].alias("start"), before.alias("before"), F.greatest(before, x["end"]).alias("after")))

    def gaps(xs: Column) -> Column:
        # what is kept lies between the furthest end so far and the start of a span beyond it
        inner = F.transform(F.filter(xs, lambda x: x["start"] > x["before"]), lambda x: F.struct(
            F.greatest(x["before"], F.lit(0)).alias("a"), x["start"].alias("b")))
        return F.concat(inner, F.array(F.struct(F.element_at(xs, -1)["after"].alias("a"), F.length(text).alias("b"))))

    def pieces(xs: Column) -> Column:
        # a block's stretch of the text is cut out first: finding a place walks the string
        last = F.floor((F.size(xs) - 1) / BLOCK).cast("int")
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: _let(F.slice(xs, k * BLOCK + 1, BLOCK), in_block)))

    def in_block(block: Column) -> Column:
        low, high = F.get(block, 0)["a"], F.element_at(block, -1)["b"]
        return _let(F.struct(low.alias("low"), text.substr(low + 1, high - low).alias("part")), lambda cut: F.transform(
            block, lambda g: cut["part"].substr(g["a"] - cut["low"] + 1, g["b"] - g["a"])))

    return F.array_join(_let(_let(reach, gaps), pieces), marker)
