"""Static rules: first match in priority order, hit counts and changes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import fixed_values as fv
from packetloom.functions.strings import strip
from packetloom.operators.telemetry import number_rows
from packetloom.schemas import RULE_TABLE
from packetloom.session import SMALL_TABLE_ROWS, cut_lineage, rows_if_small

_EQUAL = {"ip_src": F.lower, "ip_dst": F.lower, "port": lambda c: c}
_COLUMN = {"ip_src": "source_ip", "ip_dst": "destination_ip", "port": "port",
           "domain": "destination_ip", "keyword": "text_content"}
_SUBSTRING = ("domain", "keyword")
# Above this many enabled rules the chain of literals gives way to joins.
CHAIN_LIMIT = 256
_RANK_TYPE = "struct<priority:int,seq:int,id:string,action:string,match_type:string,value:string>"
_ANCHOR = 3
# Largest filter of anchors: 8 MB.
_FILTER_BITS = 26


def rules_by_priority(rules: DataFrame) -> DataFrame:
    return rules.orderBy("priority", "seq")


def _ranked(rules: DataFrame) -> DataFrame:
    """Enabled rules with their compared value and a rank to take the minimum of."""
    return rules.filter("enabled").select(
        "match_type", F.lower(strip(F.col("value"))).alias("_v"),
        F.struct("priority", "seq", "id", "action", "match_type", "value").alias("_rank"))


def _rank_literal(rule: Row) -> Column:
    return F.struct(*[F.lit(rule[name]).cast(RULE_TABLE[name].dataType).alias(name)
                      for name in ("priority", "seq", "id", "action", "match_type", "value")])


def _test(rule: Row, fields: dict[str, Column]) -> Column:
    value = F.lower(strip(F.lit(rule["value"])))  # as _ranked folds it
    field = fields[rule["match_type"]]
    return F.contains(field, value) if rule["match_type"] in _SUBSTRING else field == value


def _chain(rules: list[Row], fields: dict[str, Column]) -> Column:
    """First rule, in order, that matches; tests stop at the first hit."""
    ordered = sorted(rules, key=lambda r: (r["priority"], r["seq"]))
    return F.coalesce(*[F.when(_test(r, fields), _rank_literal(r)) for r in ordered])


def _gram_key(gram: Column) -> Column:
    """Number of a gram of up to ``_ANCHOR`` characters; 0 for the empty one."""
    return F.when(gram == "", F.lit(0).cast("long")).otherwise(F.aggregate(
        F.split(gram, ""), F.lit(0).cast("long"), lambda key, char: F.shiftleft(key, 21) + F.ascii(char) + 1))


def _gram_keys(text: str | None) -> np.ndarray:
    """Numbers of all distinct substrings of one to ``_ANCHOR`` characters, and of the empty one."""
    chars = np.frombuffer((text or "").encode("utf-32-le", errors="surrogatepass"), "<u4").astype(np.int64) + 1
    keys, longer = [np.zeros(1, np.int64)], np.zeros(len(chars), np.int64)
    for size in range(min(_ANCHOR, len(chars))):
        longer = (longer[:len(chars) - size] << 21) + chars[size:]
        keys.append(longer)
    return np.unique(np.concatenate(keys))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each key in a filter of ``2 ** bits`` bits."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    shift = np.uint64(64 - bits)
    return np.stack([mixed >> shift, (mixed << np.uint64(bits)) >> shift]).astype(np.int64)


def _anchor_filter(filed: DataFrame) -> tuple[int, np.ndarray]:
    """Bloom filter of the anchors: 16 bits or more for each, up to ``_FILTER_BITS`` in all."""
    bits = min(_FILTER_BITS, max(10, (16 * filed.count()).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], names=["word", "bits"])

    # At most one row per 64 bits of the filter.
    words = filed.select("_key").distinct().mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits, out


def _anchors_in(spark: SparkSession, filed: DataFrame):
    """Function from texts to the keys of their grams that may be anchors."""
    known = spark.sparkContext.broadcast(_anchor_filter(filed))

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def anchors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, words = known.value
        for batch in texts:
            rows = []
            for value in batch:
                keys = _gram_keys(value.as_py())
                at = _places(keys, bits)
                rows.append(keys[((words[at >> 6] >> (at & 63)) & 1).all(axis=0)])
            yield pa.array(rows, pa.list_(pa.int64()))

    return anchors


def _rarest(filed: DataFrame) -> DataFrame:
    """(_v, _rank, _gram): each rule under the one of its longest grams that the fewest rules share."""
    long = F.least(F.lit(_ANCHOR), F.length("_v"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_v") - _ANCHOR + 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring("_v", i, long)))
    each = filed.select("_v", "_rank", F.explode(grams).alias("_gram"))
    shared = each.groupBy("_gram").agg(F.count("*").alias("_n"))
    best = F.min_by(F.col("_gram"), F.struct("_n", "_gram")).alias("_gram")
    return each.join(shared, "_gram").groupBy("_v", "_rank").agg(best)


def _automaton(rules: list[Row]) -> Column:
    """Number of the winning rule in ``rules``, which come in order; -1 without one.

    Addresses and ports are looked up, domains and keywords found by one pass
    over a text for all of them.
    """
    import ahocorasick
    equal: dict[str, dict[str, int]] = {kind: {} for kind in _EQUAL}
    parts: dict[str, dict[str, int]] = {kind: {} for kind in _SUBSTRING}
    for number, rule in enumerate(rules):
        (equal if rule["match_type"] in equal else parts)[rule["match_type"]].setdefault(rule["_v"], number)

    def build(values: dict[str, int]):
        machine = ahocorasick.Automaton()
        for value, number in values.items():
            if value:
                machine.add_word(value, number)
        machine.make_automaton()
        return machine

    none = len(rules)

    @F.arrow_udf("int")
    def winner(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        machines = {kind: build(values) for kind, values in parts.items()}  # once per task
        for batch in batches:
            out = []
            for s, d, p, t in zip(*[column.to_pylist() for column in batch]):
                best = min(equal["ip_src"].get(s, none), equal["ip_dst"].get(d, none), equal["port"].get(p, none))
                for kind, value in (("domain", d), ("keyword", t)):
                    if value is not None:
                        best = min(best, parts[kind].get("", none))
                        if len(machines[kind]):
                            best = min(best, min((n for _, n in machines[kind].iter(value)), default=none))
                out.append(best if best < none else -1)
            yield pa.array(out, pa.int32())

    return winner(F.lower("source_ip"), F.lower("destination_ip"), F.col("port"), F.lower("text_content"))


def filed_by_anchor(values: DataFrame) -> DataFrame:
    """(_v, _rank, _key): ``values`` (_v, _rank), each under the number of its rarest characters."""
    return cut_lineage(_rarest(values).withColumn("_key", _gram_key(F.col("_gram"))).drop("_gram"))


def anchored_texts(once: DataFrame, filed: DataFrame) -> DataFrame:
    """(_hash, _key) of the grams of each text that are, or look in a filter like, the anchor of a rule.

    The filter is tested where the text is read, so a text gives about as many
    rows as it holds anchors, not one for every gram.
    """
    return once.select("_hash", F.explode(_anchors_in(once.sparkSession, filed)("_text")).alias("_key"))


def substring_matches(df: DataFrame, key: str, ranked: DataFrame, kind: str) -> DataFrame:
    """(key, rank) of the best substring rule, for rule tables of any size.

    Every rule is filed under its rarest characters; a text meets only the
    rules whose anchor occurs in it, and the full value is verified after the
    join, so the result is exact. Equal texts (such as destinations) are
    matched once.
    """
    filed = filed_by_anchor(ranked.filter(F.col("match_type") == kind).groupBy("_v").agg(F.min("_rank").alias("_rank")))
    text = df.select(key, F.lower(_COLUMN[kind]).alias("_text"))
    once = text.filter("_text IS NOT NULL").select("_text", F.md5("_text").alias("_hash")).dropDuplicates(["_hash"])
    pairs = anchored_texts(once, filed).join(filed, "_key").select("_hash", "_v", "_rank").distinct()
    found = pairs.join(once, "_hash").filter(F.contains("_text", F.col("_v"))).groupBy("_hash").agg(
        F.min("_rank").alias(f"_rule_{kind}"))
    return text.select(key, F.md5("_text").alias("_hash")).join(found, "_hash").drop("_hash")


def match_rules(df: DataFrame, rules: DataFrame, key: str = "id", chain_limit: int = CHAIN_LIMIT,
                table_limit: int | None = None) -> DataFrame:
    """Add ``rule``: the winning rule of each event, or null.

    A short rule list becomes one chain of literal tests in priority order:
    no join, no shuffle, usable on streams. A list that still fits a task
    becomes lookups and one search automaton, which keep no state either.
    Longer tables are split by kind: address and port rules are equality
    joins against one row per compared value, so they never multiply events;
    domain and keyword rules, which are substring tests, are joined by anchors.
    Values are folded by the same functions everywhere.
    """
    known = rows_if_small(rules.select(*RULE_TABLE.fieldNames()).filter("enabled"))
    if known is not None:
        known = [r for r in known if r["match_type"] in _COLUMN]
        if not known:
            return df.withColumn("rule", F.lit(None).cast(_RANK_TYPE))
        if len(known) <= chain_limit:
            df = df.withColumns({"_src": F.lower("source_ip"), "_dst": F.lower("destination_ip"), "_text": F.lower("text_content")})
            fields = {"ip_src": F.col("_src"), "ip_dst": F.col("_dst"), "domain": F.col("_dst"),
                      "port": F.col("port"), "keyword": F.col("_text")}
            return df.withColumn("rule", _chain(known, fields)).drop("_src", "_dst", "_text")
        if table_limit is None or len(known) <= table_limit:
            ordered = _ranked(rules).filter(F.col("match_type").isin(*_COLUMN)).orderBy("_rank.priority", "_rank.seq").collect()
            numbered = df.sparkSession.createDataFrame([(i, r["_rank"]) for i, r in enumerate(ordered)], f"_number int, rule {_RANK_TYPE}")
            return df.withColumn("_number", _automaton(ordered)).join(F.broadcast(numbered), "_number", "left").drop("_number")
    if df.isStreaming:
        raise ValueError(f"a stream takes up to {SMALL_TABLE_ROWS} rules; more need joins that keep state")
    ranked, found = _ranked(rules), []
    for kind, fold in _EQUAL.items():
        best = ranked.filter(F.col("match_type") == kind).groupBy("_v").agg(F.min("_rank").alias(f"_rule_{kind}"))
        # The row count was checked above; without that check Spark decides by size.
        best = F.broadcast(best) if known is not None else best
        df = df.join(best, fold(F.col(_COLUMN[kind])) == F.col("_v"), "left").drop("_v")
        found.append(f"_rule_{kind}")
    for kind in _SUBSTRING:
        df = df.join(substring_matches(df, key, ranked, kind), key, "left")
        found.append(f"_rule_{kind}")
    return df.withColumn("rule", F.least(*found)).drop(*found)


def rule_verdict(rule: Column) -> dict[str, Column]:
    """Status, risk, reason and rule label of a matched rule; null otherwise."""
    blocks = rule["action"] == "block"
    hit = rule.isNotNull()
    return {
        "status": F.when(hit, F.when(blocks, "block").otherwise("allow")),
        "risk_level": F.when(hit, F.when(blocks, "critical").otherwise("safe")),
        "reason": F.when(hit, F.concat(F.lit("Static rule match ("), rule["match_type"], F.lit("="), rule["value"],
                                       F.lit("): "), F.upper(rule["action"]))),
        "rule_label": F.when(hit, F.concat(F.lit("R-"), rule["id"])),
    }


def rule_hits(matched: DataFrame, rules: DataFrame, since: Column | None = None) -> DataFrame:
    """(id, hits) per rule, 0 for rules that never won."""
    wins = matched.filter(F.col("rule").isNotNull())
    if since is not None:
        wins = wins.filter(F.col("ts") >= since)
    counts = wins.groupBy(F.col("rule")["id"].alias("id")).agg(F.count("*").alias("hits"))
    return rules.select("id").join(counts, "id", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"))


def valid_rule(action: Column, match_type: Column, value: Column) -> Column:
    return F.coalesce(
        F.lower(strip(action)).isin(*fv.RULE_ACTIONS)
        & F.lower(strip(match_type)).isin(*fv.RULE_MATCH_TYPES)
        & (strip(value) != ""), F.lit(False))


def apply_rule_changes(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Rule table after a log of changes.

    ``changes`` has (change_ts, op, id, action, match_type, value, priority,
    enabled, description) with op add, delete or toggle. Invalid adds are
    ignored. A delete removes what came before it; the state of a rule is its
    last add (or base row) plus the toggles that follow. Only aggregates per
    rule id are shuffled, so one busy id does not pile up in one task. The
    result is a rule table again: rules keep position, hits and time of
    change, and added rules follow after all others in order of their adds.
    """
    ops = changes.filter((F.col("op") != "add") | valid_rule(F.col("action"), F.col("match_type"), F.col("value")))
    is_add, is_delete = F.col("op") == "add", F.col("op") == "delete"
    last = ops.groupBy("id").agg(
        F.max(F.when(is_delete, F.col("change_ts"))).alias("deleted"),
        F.max(F.when(is_add, F.col("change_ts"))).alias("added"),
        F.max_by(F.struct(
            F.lower(strip(F.col("action"))).alias("action"), F.lower(strip(F.col("match_type"))).alias("match_type"),
            strip(F.col("value")).alias("value"), F.coalesce("priority", F.lit(fv.DEFAULT_PRIORITY)).alias("priority"),
            F.coalesce("enabled", F.lit(True)).alias("enabled"), strip(F.coalesce("description", F.lit(""))).alias("description"),
        ), F.when(is_add, F.col("change_ts"))).alias("new"))
    start = last.join(base.select("id", F.struct("action", "match_type", "value", "priority", "enabled", "description", "hits24h", "updated", "seq").alias("old")),
                      "id", "full")
    fresh = F.col("added").isNotNull() & (F.col("deleted").isNull() | (F.col("added") > F.col("deleted")))
    kept = F.col("old").isNotNull() & F.col("deleted").isNull()
    old = lambda name: F.when(~fresh, F.col("old")[name])
    live = start.filter(fresh | kept).select(
        "id", *[F.when(fresh, F.col("new")[name]).otherwise(F.col("old")[name]).alias(name)
                for name in ("action", "match_type", "value", "priority", "enabled", "description")],
        F.coalesce(old("hits24h"), F.lit(0)).cast("long").alias("hits24h"), old("updated").cast("string").alias("_updated"), old("seq").alias("seq"),
        F.when(fresh, F.col("added")).alias("since"))
    toggles = ops.filter("op = 'toggle'").select("id", "change_ts").join(live.select("id", "since"), "id") \
        .filter(F.col("since").isNull() | (F.col("change_ts") > F.col("since"))) \
        .groupBy("id").agg(F.count("*").alias("flips"), F.max("change_ts").alias("flipped"))
    flipped = F.coalesce(F.col("flips") % 2 == 1, F.lit(False))
    added = number_rows(live.filter("since IS NOT NULL").select("id", "since"), "_nth", "since", "id").select("id", "_nth")
    first = base.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
    return live.join(toggles, "id", "left").join(added, "id", "left").select(
        "id", "action", "match_type", "value", F.col("priority").cast("int").alias("priority"),
        F.when(flipped, ~F.col("enabled")).otherwise(F.col("enabled")).alias("enabled"), "description", "hits24h",
        F.coalesce(F.coalesce("flipped", "since").cast("string"), "_updated").alias("updated"),
        F.coalesce("seq", F.col("_nth") + F.lit(first - 1)).cast("int").alias("seq"))


def rule_view(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules as the rules page lists them."""
    from packetloom.functions.timestamps import age_text, epoch_micros
    category = F.create_map(*[F.lit(x) for pair in fv.RULE_CATEGORIES.items() for x in pair])
    action = F.when(F.col("action") == "allow", "Allow").when(F.col("action") == "block", "Block").otherwise(F.col("action"))
    seconds = (epoch_micros(as_of) - epoch_micros(F.col("updated"))) / F.lit(1_000_000)
    return rules.select(
        F.concat(F.lit("R-"), "id").alias("id"),
        F.coalesce(F.nullif("description", F.lit("")), F.concat_ws(" ", "match_type", "action", "value")).alias("name"),
        F.coalesce(F.element_at(category, F.col("match_type")), F.lit("Custom")).alias("category"),
        action.alias("action"), F.concat("match_type", F.lit("="), "value").alias("targets"),
        F.coalesce("hits24h", F.lit(0)).alias("hits24h"), "enabled",
        F.when(F.col("updated").isNull(), "just now").otherwise(age_text(seconds)).alias("updated"))


def search_rules(view: DataFrame, query: str = "", category: str = "All") -> DataFrame:
    """Rules of a category whose name or id contains the query text."""
    low = F.lit(query.lower())
    found = view.filter(F.contains(F.lower("name"), low) | F.contains(F.lower("id"), low))
    return found if category == "All" else found.filter(F.col("category") == category)


def rule_categories(view: DataFrame) -> DataFrame:
    return view.select("category").distinct()


def rule_activity(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count_if("enabled").alias("active"), F.count("*").alias("total"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
