"""Packing named slots into a prompt of bounded tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions.text import rough_tokens

#: Priorities, and the preset slots with their suggested shares.
PRIORITIES = {"LOW": 10, "NORMAL": 50, "HIGH": 80, "CRITICAL": 100}
PRESET_SLOTS = [
    ("system", 0.08, 100), ("task", 0.08, 80), ("pinned_facts", 0.08, 80), ("project_context", 0.12, 80), ("spec", 0.08, 80),
    ("repo_map", 0.10, 50), ("evidence", 0.35, 50), ("memory", 0.05, 10), ("verifier_feedback", 0.03, 80), ("output_contract", 0.03, 100),
]

#: A slot that doesn't fit is cut if more than so many tokens are left, to the
#: tokens left less so many for the note.
LEAST_LEFT, NOTE_TOKENS = 50, 5
NOTE = "\n... [truncated]"


def preset_slots(spark) -> DataFrame:
    """The preset slots: (name, content, priority, budget_pct, insert_ord)."""
    rows = [(n, "", p, s, k) for k, (n, s, p) in enumerate(PRESET_SLOTS)]
    return spark.createDataFrame(rows, "name string, content string, priority int, budget_pct double, insert_ord int")


def with_presets(slots: DataFrame) -> DataFrame:
    """Slots of each prompt laid over the presets: (prompt_id, name, content,
    priority, budget_pct, insert_ord). The last input of a name wins; a preset
    keeps its priority unless one is given, a new name is NORMAL."""
    presets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("").alias("c0"), F.lit(p).alias("p0"), F.lit(b).alias("b0"), F.lit(k).alias("o0")) for k, (n, b, p) in enumerate(PRESET_SLOTS)])
    last = slots.groupBy("prompt_id", "name").agg(
        F.max_by(F.struct("content"), "insert_ord")["content"].alias("content"),
        F.max_by("priority", F.when(F.col("priority").isNotNull(), F.col("insert_ord"))).alias("priority"),
        F.min("insert_ord").alias("first_ord"),
    )
    prompts = slots.select("prompt_id").distinct().select("prompt_id", F.inline(presets))
    both = prompts.join(last, ["prompt_id", "name"], "full_outer")
    return both.select(
        "prompt_id", "name", F.coalesce("content", "c0").alias("content"), F.coalesce("priority", "p0", F.lit(50)).alias("priority"),
        F.coalesce("b0", F.lit(0.0)).alias("budget_pct"), F.coalesce("o0", F.col("first_ord") + len(PRESET_SLOTS)).alias("insert_ord"),
    )


def greedy_pack(slots: DataFrame, token_budget: int = 8000, count: Column | None = None) -> DataFrame:
    """Decides for each slot of a prompt whether it is whole, cut or dropped.

    ``slots`` has prompt_id, name, content, priority, insert_ord; ``count``
    gives a slot's tokens (a rough count unless given). Gives one row per
    non-empty slot: ``tokens``, ``used`` and ``fate`` (whole, cut, dropped). If
    all fit, all are whole. Else slots go by priority, then insertion: one that
    fits what is left is whole; one that doesn't is cut if more than LEAST_LEFT
    tokens are left, and dropped otherwise, after which smaller ones may still
    fit. A prompt has tens of slots; each is folded within one row.
    """
    sized = slots.where(F.col("content").isNotNull() & (F.col("content") != "")).withColumn("tokens", (count if count is not None else rough_tokens(F.col("content"))).cast("long"))
    grouped = sized.groupBy("prompt_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("np"), "insert_ord", "name", "tokens", "content"))).alias("s"), F.sum("tokens").alias("total")
    )
    empty = F.array().cast("array<struct<name:string,insert_ord:int,priority:int,tokens:bigint,used:bigint,fate:string,content:string>>")
    start = F.struct(F.lit(token_budget).cast("long").alias("left"), empty.alias("done"))

    def step(acc, x):
        fits = (F.col("total") <= token_budget) | (x["tokens"] <= acc["left"])
        cut = acc["left"] > LEAST_LEFT
        used = F.when(fits, x["tokens"]).when(cut, acc["left"]).otherwise(F.lit(0).cast("long"))
        fate = F.when(fits, "whole").when(cut, "cut").otherwise("dropped")
        row = F.struct(
            x["name"].alias("name"), x["insert_ord"].cast("int").alias("insert_ord"), (-x["np"]).cast("int").alias("priority"), x["tokens"].alias("tokens"), used.alias("used"), fate.alias("fate"), x["content"].alias("content"),
        )
        return F.struct((acc["left"] - used).alias("left"), F.concat(acc["done"], F.array(row)).alias("done"))

    folded = grouped.withColumn("done", F.aggregate("s", start, step, lambda acc: acc["done"]))
    return folded.select("prompt_id", F.explode("done").alias("d")).select("prompt_id", "d.*")


def cut_text(content: Column, used: Column) -> Column:
    """The first used - NOTE_TOKENS rough tokens of a text and a note."""
    pattern = r"\s*(?:[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9])"
    kept = F.slice(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)), 1, F.greatest(used - NOTE_TOKENS, F.lit(0)).cast("int"))
    return F.concat(F.array_join(kept, ""), F.lit(NOTE))


def render_prompt(packed: DataFrame) -> DataFrame:
    """(prompt_id, prompt): the slots that remain in tags, presets in their
    order, others behind in the order of packing. Tags cost no budget."""
    canon = {n: k for k, (n, _, _) in enumerate(PRESET_SLOTS)}
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in canon.items() for x in kv])[F.col("name")], F.lit(len(canon)))
    text = F.when(F.col("fate") == "cut", cut_text(F.col("content"), F.col("used"))).otherwise(F.col("content"))
    block = F.concat(F.lit("<"), F.col("name"), F.lit(">\n"), text, F.lit("\n</"), F.col("name"), F.lit(">"))
    kept = packed.where("fate <> 'dropped'").select("prompt_id", F.struct(place.alias("place"), (-F.col("priority")).alias("np"), "insert_ord", block.alias("block")).alias("b"))
    return kept.groupBy("prompt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n").alias("prompt"))


def pack_stats(slots: DataFrame, token_budget: int = 8000, count: Column | None = None) -> DataFrame:
    """Per prompt ``budget``, ``total_before_trim``, ``over_budget`` and
    ``slots``, a map from name to tokens, priority name and share."""
    sized = slots.where(F.col("content").isNotNull() & (F.col("content") != "")).withColumn("tokens", (count if count is not None else rough_tokens(F.col("content"))).cast("long"))
    names = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in (kv[1], kv[0])])
    entry = F.struct(F.col("name"), F.struct("tokens", names[F.col("priority")].alias("priority"), F.col("budget_pct").alias("pct")))
    return sized.groupBy("prompt_id").agg(
        F.lit(token_budget).alias("budget"), F.sum("tokens").alias("total_before_trim"), F.greatest(F.sum("tokens") - token_budget, F.lit(0)).alias("over_budget"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("slots"),
    )
