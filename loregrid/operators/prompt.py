"""Turning results into prompts: sanitising, deduplication, grouping, budget and assembly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.text import literal_map, prompt_tokens, sanitized
from ..schemas import BACKGROUND_SHARE, LAST_ORDER, TYPE_LABEL, TYPE_ORDER, USER_TOKENS
from . import near_copies
from .near_copies import may_share, places

# Texts of the prompt's sections, and the meta fields that are sanitised.
ROLE = "资深软件工程师"
SYSTEM = "你是一个{role}，请严格遵守以下规范约束。\n\n## 强制规范（必须遵守）\n"
NO_SPECS = "无特定规范约束。"
ARCHITECTURE = "\n## 架构概览\n"
BACKGROUND = "以下是从私域知识库检索到的相关知识，请作为生成代码的参考背景：\n\n"
CONSTRAINTS = "## 生成约束\n"
SDK_HEADING = "### 方法签名（SDK 源码）\n"
DOC_HEADING = "\n### 参考文档\n"
USER = "## 用户需求\n"
BADGES = {"sdk_code": " [SDK源码]", "doc": " [文档]"}
META_FIELDS = ["code_example", "related_entity", "security_rule", "config_required", "definition_text", "definition", "source"]


def sanitize(items: DataFrame, fields: tuple[str, ...] = ("content",), normalize: bool = True) -> DataFrame:
    """items with the fields sanitised, and modified: whether any changed. A null stays null."""
    if normalize:  # texts pass through Python
        small_batches(items.sparkSession)
    new = items.withColumns({f"_new_{f}": sanitized(F.col(f), normalize) for f in fields})
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~F.col(f"_new_{f}").eqNullSafe(F.col(f))
    return new.withColumn("modified", changed).withColumns({f: F.col(f"_new_{f}") for f in fields}).drop(*[f"_new_{f}" for f in fields])


def sanitized_meta(meta: DataFrame, column: str = "meta_json", normalize: bool = True) -> DataFrame:
    """meta with the named fields of the column's JSON object sanitised, texts and lists of texts alike; other fields stay as they are. What isn't an object stays."""
    held = F.from_json(column, "MAP<STRING, STRING>")
    new = F.map_from_arrays(F.array(*[F.lit(f) for f in META_FIELDS]), F.array(*[sanitized(F.coalesce(F.try_element_at(held, F.lit(f)), F.lit("")), normalize) for f in META_FIELDS]))
    meta = meta.withColumns({"_held": held, "_new": new})
    clean = F.transform_values("_held", lambda k, v: F.when(v.isNotNull() & F.map_contains_key("_new", k), F.try_element_at(F.col("_new"), k)).otherwise(v))
    return meta.withColumn(column, F.when(F.col("_held").isNotNull(), F.to_json(clean)).otherwise(F.col(column))).drop("_held", "_new")


def sanitization_log(items: DataFrame, key: str = "id", normalize: bool = True) -> DataFrame:
    """item_id, original_hash, action of every item that sanitising changes."""
    changed = ~sanitized(F.col("content"), normalize).eqNullSafe(F.col("content"))
    return items.where(changed).select(F.col(key).alias("item_id"), F.substring(F.md5(F.col("content").cast("binary")), 1, 8).alias("original_hash"), F.lit("cleaned").alias("action"))


def dedup_by_id(items: DataFrame) -> DataFrame:
    """The best-scored row of each query's ids; a null score counts as 0."""
    order = Window.partitionBy("query_id", "id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")
    return items.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def dedup_by_content(items: DataFrame) -> DataFrame:
    """The best-scored row of each query's contents, whatever the case; empty contents are all kept."""
    order = Window.partitionBy("query_id", F.md5(F.lower("content").cast("binary"))).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")
    full = items.where("content <> ''").withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    return full.unionByName(items.where("content IS NULL OR content = ''"))


def dedup_near(items: DataFrame, ratio: float = 0.92, kept_most: int | None = None) -> DataFrame:
    """items without those too similar to one kept before them (of the first kept_most, if given), best scores first.

    Texts are compared in lower case by the share of matching blocks, and only where neither is more than twice as long as the other. Where all are compared, texts that may be near each other are found
    by classes of length first, and each part of them is then gone through by itself; the others stay. With kept_most a query's items are one task. Pairs whose lengths, counts of characters,
    runs of four characters or longest common subsequence rule out the ratio are not compared; these are bounds, so no pair is lost.
    """
    import difflib

    import numpy as np

    names = items.columns

    def run(pdf):
        kept, rows, seen = [], [], set()
        sizes, chars, runs = np.zeros(16, np.int64), np.zeros((16, 128), np.int32), []
        order = pdf.assign(_s=pdf["score"].fillna(0.0)).sort_values(["_s", "ord", "content"], ascending=[False, True, True], kind="stable").drop(columns="_s")

        def near(text, n, own, quads):
            most = len(kept) if kept_most is None else min(kept_most, len(kept))
            both = sizes[:most] + n
            at = np.flatnonzero((2 * np.minimum(sizes[:most], n) >= ratio * both - 1e-6) & (sizes[:most] <= 2 * n) & (n <= 2 * sizes[:most]))
            at = at[2 * np.minimum(chars[at], own).sum(1) >= ratio * both[at] - 1e-6]
            spots = blocks = None
            for k in at:
                total = both[k]
                match = int(near_copies.least_matching(total, ratio))
                # matches lie in at most one block more than there are characters unmatched, and a block has three runs fewer than characters
                least = match - 3 * (total - 2 * match + 1)
                if least > 0 and len(np.intersect1d(quads, runs[k], assume_unique=True)) < least:
                    continue
                # matching blocks are a common subsequence
                spots = places(text) if spots is None else spots
                if not may_share(kept[k], spots, n, match):
                    continue
                blocks = blocks or difflib.SequenceMatcher(None, "", text)  # what it makes of its second text serves all the first ones
                blocks.set_seq1(kept[k])
                if near_copies.reaches(blocks, ratio):
                    return True
            return False

        for i, content in zip(order.index, order["content"]):
            text = (content or "").lower()
            if not text:
                rows.append(i)
                continue
            if kept_most is None and text in seen:  # kept, or near one that is
                continue
            seen.add(text)
            codes = near_copies.codes(text)
            own, quads = near_copies.char_counts(codes), near_copies.quads(codes)
            if near(text, len(text), own, quads):
                continue
            rows.append(i)
            if len(kept) == len(sizes):
                sizes, chars = np.concatenate([sizes, np.zeros_like(sizes)]), np.concatenate([chars, np.zeros_like(chars)])
            sizes[len(kept)], chars[len(kept)] = len(text), own
            kept.append(text)
            runs.append(quads)
        return order.loc[rows, names]

    if kept_most is not None:
        return items.groupBy("query_id").applyInPandas(run, items.schema)
    spark = items.sparkSession
    keyed = items.withColumn("_key", F.xxhash64("content", "score", "ord"))
    parts = near_copies.parts(keyed, ratio)
    parts = parts.checkpoint() if spark.sparkContext.getCheckpointDir() else parts.cache()
    alone = keyed.join(parts, ["query_id", "_key"], "left_anti").select(names)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    linked = keyed.join(parts, ["query_id", "_key"]).repartition(tasks, "query_id", "_part")
    return alone.unionByName(linked.groupBy("query_id", "_part").applyInPandas(run, items.schema))


def type_rank(kind: Column) -> Column:
    return literal_map(TYPE_ORDER, LAST_ORDER)(kind)


def grouped(items: DataFrame) -> DataFrame:
    """items with type_rank, and group_rank: the place within the type by score."""
    order = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), "ord")
    return items.withColumn("type_rank", type_rank(F.col("type"))).withColumn("group_rank", F.row_number().over(order))


def formatted(kind: Column, score: Column, content: Column, source: Column | None = None, example: Column | None = None, related: Column | None = None) -> Column:
    """One item as text."""
    badge = literal_map(BADGES, "")(source) if source is not None else F.lit("")
    label = F.coalesce(literal_map(TYPE_LABEL, None)(kind), kind)
    head = F.concat(F.lit("### ["), label, F.lit("]"), F.coalesce(badge, F.lit("")), F.lit(" (score: "), F.format_string("%.2f", F.bround(score, 2)), F.lit(")"))
    more = [F.when(F.length(example) > 0, F.concat(F.lit("\n示例代码:\n```\n"), example, F.lit("\n```")))] if example is not None else []
    more += [F.when(F.length(related) > 0, F.concat(F.lit("关联实体: "), related))] if related is not None else []
    return F.concat_ws("\n", head, content, *more, F.lit(""))


def constraints(items: DataFrame) -> DataFrame:
    """query_id, constraint lines (array, each once, in the items' order) of items (query_id, ord, version, deprecated_in, security_rule); a since_version goes before the version."""
    line = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"- {label}: "), F.col(c)))
    since = F.coalesce(F.nullif("since_version", F.lit("")), "version") if "since_version" in items.columns else F.col("version")
    items = items.withColumn("version", since)
    each = F.array_compact(F.array(line("版本要求", "version"), line("已废弃于", "deprecated_in"), line("安全要求", "security_rule")))
    held = items.select("query_id", F.posexplode(each).alias("n", "line"), "ord")
    first = held.groupBy("query_id", "line").agg(F.min(F.struct("ord", "n")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))


def budgeted(items: DataFrame, remaining: Column, start: int) -> DataFrame:
    """items (query_id, text, type, score, ord) with kept: whether the running sum of their tokens stays within the budget; as tokens aren't negative, that ends at the first overflow."""
    order = Window.partitionBy("query_id").orderBy(type_rank(F.col("type")), F.desc("score"), "ord").rowsBetween(Window.unboundedPreceding, 0)
    costed = items.withColumn("item_tokens", prompt_tokens(F.col("text")))
    return costed.withColumn("running", F.sum("item_tokens").over(order)).withColumn("kept", F.col("running") + start <= remaining * BACKGROUND_SHARE)


def assemble(items: DataFrame, requests: DataFrame, specs: DataFrame | None = None) -> DataFrame:
    """query_id, system, background, user_request, constraints, prompt, input_items, after_truncation, estimated_tokens, budget_remaining.

    items: query_id, id, type, content, score, ord, source, version, deprecated_in, security_rule. requests: query_id, query, max_tokens, role (null: the
    usual one). specs: query_id, ord, rule, positive_example, negative_example. Items with source sdk_code come first; others follow if those all fit.
    Where they are there: items' since_version, code_example and related_entity, requests' architecture (a text for the system section) and dependencies
    (an array of name and version for the constraints).
    """
    items = _keyed(items)
    return _prompts(_costed(items), items, requests, specs).drop("given", "sanitized_items")


#: Columns of items that only the text of an item needs.
LONG = ("content", "code_example", "related_entity")


def _keyed(items: DataFrame) -> DataFrame:
    """items with _key, which rows share only if they are the same in every column."""
    return items.withColumn("_key", F.md5(F.to_json(F.struct(*items.columns)).cast("binary")))


def _line(items: DataFrame) -> Column:
    more = [F.col(c) if c in items.columns else F.lit(None).cast("string") for c in LONG[1:]]
    return formatted(F.col("type"), F.col("score"), F.col("content"), F.col("source"), *more)


def _costed(items: DataFrame) -> DataFrame:
    """items with sdk and item_tokens in place of their long texts, which no exchange carries then."""
    return items.withColumns({"sdk": F.coalesce(F.col("source") == "sdk_code", F.lit(False)), "item_tokens": prompt_tokens(_line(items))}).drop(*LONG)


def _prompts(slim: DataFrame, texts: DataFrame, requests: DataFrame, specs: DataFrame | None, clean: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """assemble() of slim, as _costed() gives it; the texts of those that the budget keeps are fetched by _key from texts, and cleaned then. given and sanitized_items sum slim's _given and _modified, if there."""
    items = slim
    extra = lambda df, c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit(ROLE))
    ask = requests.withColumn("system", F.replace(F.lit(SYSTEM), F.lit("{role}"), role))
    if specs is not None:
        line = F.concat(F.lit("- "), "rule", F.coalesce(F.concat(F.lit("\n  正例: "), F.nullif("positive_example", F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit("\n  反例: "), F.nullif("negative_example", F.lit(""))), F.lit("")))
        rules = specs.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("rules"))
        ask = ask.join(rules, "query_id", "left")
    else:
        ask = ask.withColumn("rules", F.lit(None).cast("string"))
    overview = F.concat(F.lit(ARCHITECTURE), F.nullif(extra(requests, "architecture", "string"), F.lit("")))
    ask = ask.withColumn("system", F.concat_ws("\n", "system", F.coalesce("rules", F.lit(NO_SPECS)), overview)).join(constraints(items), "query_id", "left")
    needs = extra(requests, "dependencies", "array<struct<name: string, version: string>>")
    needs = F.when(F.size(needs) > 0, F.concat(F.lit("- 项目依赖: "), F.array_join(F.transform(needs, lambda d: F.concat(d["name"], F.lit("@"), d["version"])), ", ")))
    ask = ask.withColumn("lines", F.array_compact(F.concat(F.coalesce("lines", F.expr("CAST(array() AS array<string>)")), F.array(needs))))
    ask = ask.withColumn("constraints", F.when(F.size("lines") > 0, F.concat(F.lit(CONSTRAINTS), F.array_join("lines", "\n"))).otherwise(""))
    ask = ask.withColumn("remaining", F.col("max_tokens") - prompt_tokens(F.col("system")) - prompt_tokens(F.col("constraints")) - USER_TOKENS)
    held = items.join(ask.select("query_id", "remaining"), "query_id")
    order = [F.desc("sdk"), F.when(F.col("sdk"), 0).otherwise(type_rank(F.col("type"))), F.when(F.col("sdk"), 0.0).otherwise(F.col("score")).desc(), "ord"]
    whole, so_far = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    head = prompt_tokens(F.lit(BACKGROUND))
    heads = F.when(F.max("sdk").over(whole), prompt_tokens(F.lit(SDK_HEADING))).otherwise(0) + F.when(F.col("sdk"), 0).otherwise(prompt_tokens(F.lit(DOC_HEADING)))
    held = held.withColumn("kept", F.sum("item_tokens").over(so_far) + head + heads <= F.col("remaining") * BACKGROUND_SHARE).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    held = held.withColumn("kept", F.min("kept").over(so_far))
    total = lambda c: F.sum(c) if c in items.columns else F.lit(0).cast("long")
    counts = ("input_items", "after_truncation", "n_sdk", "kept_sdk", "given", "sanitized_items")
    per = held.groupBy("query_id").agg(
        F.count("*").alias("input_items"), F.count_if("kept").alias("after_truncation"), F.count_if("sdk").alias("n_sdk"), F.count_if(F.col("sdk") & F.col("kept")).alias("kept_sdk"),
        total("_given").alias("given"), total("_modified").alias("sanitized_items"), F.collect_list(F.when(F.col("kept"), F.struct("place", "sdk", "_key"))).alias("keys"))
    flat = per.select("query_id", *counts, F.explode_outer("keys").alias("k")).select("query_id", *counts, "k.*")
    lines = clean(flat.join(texts.dropDuplicates(["query_id", "_key"]).drop(*counts, "place", "sdk"), ["query_id", "_key"], "left"))
    lines = lines.withColumn("text", _line(lines)).groupBy("query_id").agg(*[F.first(c).alias(c) for c in counts], F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "sdk", "text")))).alias("texts"))
    out = ask.join(lines, "query_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    of = lambda is_sdk: F.transform(F.filter("texts", lambda t: t["sdk"] == is_sdk), lambda t: t["text"])
    left = F.col("input_items") - F.col("after_truncation")
    note = F.concat(F.lit("\n[以下 "), left.cast("string"), F.lit(" 条知识因 token 预算限制省略]\n"))
    none = F.expr("CAST(array() AS array<string>)")
    pieces = F.concat(
        F.array(F.lit(BACKGROUND)),
        F.when(F.col("n_sdk") > 0, F.concat(F.array(F.lit(SDK_HEADING)), of(True))).otherwise(none),
        F.when((F.col("input_items") > F.col("n_sdk")) & (F.col("kept_sdk") == F.col("n_sdk")), F.concat(F.array(F.lit(DOC_HEADING)), of(False))).otherwise(none),
        F.when(left > 0, F.array(note)).otherwise(none))
    out = out.withColumn("background", F.when(F.col("texts").isNull(), F.lit(BACKGROUND)).otherwise(F.array_join(pieces, "\n"))).withColumn("user_request", F.concat(F.lit(USER), "query"))
    sections = ("system", "background", "user_request", "constraints")
    total = sum((prompt_tokens(F.col(c)) for c in sections), F.lit(0))
    out = out.withColumn("estimated_tokens", total).withColumn("budget_remaining", F.greatest(F.lit(0), F.col("max_tokens") - F.col("estimated_tokens")))
    return out.select("query_id", *sections, F.concat_ws("\n\n", *[F.nullif(F.col(c), F.lit("")) for c in sections]).alias("prompt"), "input_items", "after_truncation", "estimated_tokens", "budget_remaining", "given", "sanitized_items")


def assembled(items: DataFrame, requests: DataFrame, specs: DataFrame | None = None, near: bool = False, kept_most: int | None = 50, normalize: bool = True) -> DataFrame:
    """From raw items to prompts: sanitised, one row for each id and each content (with near also none too similar to one of the kept_most best kept), then as assemble().

    Its input_items counts the rows given; after_dedup those left to assemble() and sanitized_items those that sanitising changed are added. Requests without items have 0.
    """
    items = _keyed(items)
    clean = lambda df: sanitize(df, normalize=normalize).drop("modified")
    count = lambda c, *by: F.sum(c).over(Window.partitionBy("query_id", *by))
    same = F.when(F.col("content") != "", F.md5(F.lower("content").cast("binary"))).otherwise(F.concat(F.lit("none "), "_key"))  # empty contents are all kept
    slim = sanitize(items, normalize=normalize).withColumns({"_same": same, "_given": F.lit(1).cast("long"), "_modified": F.col("modified").cast("long")}).drop("modified")
    slim = slim if near else _costed(slim)
    slim = dedup_by_id(slim.withColumns({c: count(c, "id") for c in ("_given", "_modified")}))
    if near:  # compares texts, and counts before it leaves rows out
        slim = _costed(dedup_near(slim.withColumns({c: count(c) for c in ("_given", "_modified")}), kept_most=kept_most))
        first = Window.partitionBy("query_id").orderBy("_key")
        slim = slim.withColumns({c: F.when(F.row_number().over(first) == 1, F.col(c)).otherwise(0) for c in ("_given", "_modified")})
    else:
        order = Window.partitionBy("query_id", "_same").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "ord")
        slim = slim.withColumns({c: count(c, "_same") for c in ("_given", "_modified")} | {"_k": F.row_number().over(order)}).where("_k = 1").drop("_k")
    out = _prompts(slim, items, requests, specs, clean).withColumnsRenamed({"input_items": "after_dedup", "given": "input_items"})
    return out
