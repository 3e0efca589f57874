"""Secret scan with linking of multipart credentials; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, table, text_or_empty


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?({VALUE})"""
#: A run of these that long is the same span as the shorter pattern followed by a test of the length.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Weak parts: runs that mean nothing alone. A key id has capitals and digits only, a key value has all
#: three sorts of characters, an endpoint is a service address.
KEY_ID = "[A-Za-z0-9]{16,}"
KEY_VALUE = "[A-Za-z0-9+/]{32,}"
ENDPOINT = "[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9.:-]+"
KINDS = ("assign", "access", "hex", "key_id", "key_value", "endpoint")
#: Parts whose starts are so many code points apart, at most, are of one scope.
SCOPE = 240
ASSIGNED_LEAST = 6
#: Copies of a text are dealt over so many keys where its links are brought back to them.
SALTS = 32
SPAN = "struct<start:int,ord:int,`end`:int>"


def located(text: Column, pattern: str, ord_: int, keep=None, group: int = 0) -> Column:
    """Spans of a pattern's matches: start, ord of the kind and end, in code points.

    The pieces between matches and the matches take turns, so their lengths add up to positions. keep
    gets a match (its given group) and says whether it counts; a match that doesn't is still passed over.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("h"), tested.alias("g")), lambda x: x["h"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["h"])
        span = F.array(F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end")))
        out = F.concat(acc["out"], span)
        return F.struct(end.alias("at"), (out if keep is None else F.when(keep(x["g"]), out).otherwise(acc["out"])).alias("out"))

    found = F.aggregate(steps, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def _mixed(x: Column, *patterns: str) -> Column:
    out = F.lit(True)
    for p in patterns:
        out = out & x.rlike(p)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, tid (SHA-256 of the text), base spans and weak spans of every row; a null text is empty."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    base = F.array_sort(
        F.concat(
            located(text, ASSIGN, 0, lambda g: F.length(g) >= ASSIGNED_LEAST, 2),
            located(text, ACCESS, 1),
            located(text, HEX, 2),
        )
    )
    weak = F.concat(
        located(text, KEY_ID, 3, lambda g: _mixed(g, "[0-9]", "[A-Z]") & ~g.rlike("[a-z]")),
        located(text, KEY_VALUE, 4, lambda g: _mixed(g, "[0-9]", "[A-Z]", "[a-z]")),
        located(text, ENDPOINT, 5),
    )
    return rows.select("doc_id", F.sha2(text.cast("binary"), 256).alias("tid"), base.alias("base"), weak.alias("weak"))


def _overlaps(x: Column, y: Column) -> Column:
    return (x["start"] < y["end"]) & (y["start"] < x["end"])


def _free_spans() -> Column:
    """Base spans, and the weak ones that no base span covers."""
    return F.concat("base", F.filter("weak", lambda w: ~F.exists("base", lambda b: _overlaps(w, b))))


def _complementary(spans) -> Column:
    """Whether spans hold an identifier, a secret and a weak part; without these, a text has no links."""
    kinds = lambda *of: F.exists(spans, lambda x: x["ord"].isin(*of))
    return kinds(1, 3) & kinds(0, 2, 4) & kinds(3, 4, 5)


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(tid, links): the weak spans that complementary parts support.

    Identifiers (access, key_id) and secrets (assign, hex, key_value) of one text are joined where they
    start within a scope of each other; both parts count then. An endpoint counts within a scope of a
    linked identifier. Weak parts that a base span covers stand for nothing new and are left out.
    """
    once = scanned.select("tid", _free_spans().alias("s")).filter(_complementary("s")).dropDuplicates(["tid"])
    parts = once.select("tid", F.explode("s").alias("s")).select("tid", "s", F.floor(F.col("s.start") / scope).cast("int").alias("cell"))
    near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select("tid", F.col("s").alias("t"), near.alias("cell"))
        return left.join(other, ["tid", "cell"]).filter(F.abs(F.col("s.start") - F.col("t.start")) <= scope)

    ids, values = parts.filter(F.col("s.ord").isin(1, 3)), parts.filter(F.col("s.ord").isin(0, 2, 4))
    pairs = joined(ids, values).filter(~_overlaps(F.col("s"), F.col("t")))
    both = pairs.select("tid", "s", "cell").union(pairs.select("tid", F.col("t"), F.floor(F.col("t.start") / scope).cast("int"))).distinct()
    ends = joined(parts.filter("s.ord = 5"), both.filter(F.col("s.ord").isin(1, 3))).select("tid", "s")
    return both.select("tid", "s").union(ends).distinct().filter("s.ord > 2").groupBy("tid").agg(F.array_sort(F.collect_list("s")).alias("links"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, tid, base (spans found by pattern), spans (these and the linked ones).

    Equal texts are linked once. Only rows that can have links are joined with them, copies of a text over
    several keys. Null texts are empty; null and repeated doc_ids are carried through.
    """
    scanned = materialize(scan(docs).withColumn("open", _complementary(_free_spans())), "scan")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    found = linked(scanned.filter("open"), scope).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = scanned.filter("open").select("doc_id", "tid", "base", salt.alias("salt")).join(found, ["tid", "salt"], "left").drop("salt")
    rows = rows.unionByName(scanned.filter("not open").select("doc_id", "tid", "base"), allowMissingColumns=True)
    return rows.select("doc_id", "tid", "base", F.array_sort(F.concat("base", F.coalesce("links", F.array().cast(f"array<{SPAN}>")))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans, which come sorted by start, replaced by the mask."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], before).alias("out"))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
