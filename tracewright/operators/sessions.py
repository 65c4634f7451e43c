"""Sessions of coding agents: which prompts of a turn log a human wrote, and which repeat the one before.

Everything is windows over a session's turns; nothing is folded in Python, so a session may be as long as it likes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..runtime import cut
from . import build as B


def user_prompts(log: DataFrame) -> DataFrame:
    """``session_id, turn_number, turn_id, content, is_command, agent_before`` of the prompts, and the log's other columns.

    Bodies of skills and commands are dropped, pure command blocks reduced to what was typed. ``agent_before`` tells whether
    the agent answered since the prompt before; false for a session's first.
    """
    p = B.agent_turns_before(log).where((F.col("turn_type") == "user_prompt") & F.col("content").isNotNull() & ~T.is_command_body("content"))
    p = p.withColumn("_c", T.normalize_command("content")).withColumn("content", F.col("_c.text")).withColumn("is_command", F.col("_c.is_command")).drop("_c")
    before = F.lag("cum_agent").over(_in_session())
    return p.withColumn("agent_before", F.coalesce(F.col("cum_agent") > before, F.lit(False)))


def _in_session() -> Window:
    return Window.partitionBy("session_id").orderBy("turn_number", "turn_id")


def merged_markdown(prompts: DataFrame) -> DataFrame:
    """Runs of prompts that open with ``#`` and have no answer between them as one prompt, the first one's columns kept."""
    w = _in_session()
    md = ~F.col("is_command") & F.regexp_replace("content", r"^\s+", "").startswith("#")
    joins = md & F.coalesce(F.lag(md).over(w), F.lit(False)) & ~F.col("agent_before")
    p = prompts.withColumn("_joins", joins)
    p = p.withColumn("_run", F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.where("_joins").select("session_id", "_run").distinct()
    several = p.join(runs, ["session_id", "_run"], "left_semi").groupBy("session_id", "_run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "turn_id", "content"))), lambda x: x["content"]), "\n\n").alias("_text")
    )
    out = p.where("not _joins").join(several, ["session_id", "_run"], "left")
    return out.withColumn("content", F.coalesce("_text", "content")).drop("_text", "_run", "_joins")


def human_prompts(prompts: DataFrame, longest: int = 8000) -> DataFrame:
    """``prompts`` with ``text`` and ``reason``: what a human typed, and why a prompt isn't a human's (null: it is).

    A prompt right after an injected one or a command, without an answer between, that looks like a piece of a document
    carries the injection on. The state that is carried is that of the last prompt that doesn't itself depend on it, so
    one window finds it.
    """
    text = F.when(F.col("is_command"), F.col("content")).otherwise(T.strip_wrappers("content"))
    p = prompts.withColumn("text", text)
    own = F.when(F.col("is_command"), F.when(F.length("content") >= longest, "too-long")).otherwise(T.nonhuman_reason("text", longest))
    p = p.withColumn("_own", own)
    depends = ~F.col("is_command") & F.col("_own").isNull() & ~F.col("agent_before") & T.continues("text")
    state = F.when(~depends, F.col("is_command") | F.col("_own").isNotNull())
    before = F.last(state, ignorenulls=True).over(_in_session().rowsBetween(Window.unboundedPreceding, -1))
    carried = depends & F.coalesce(before, F.lit(False))
    return p.withColumn("reason", F.coalesce("_own", F.when(carried, "continuation"))).drop("_own")


def clean_prompts(prompts: DataFrame, scrub) -> DataFrame:
    """Texts scrubbed, empty where nothing is left; of a command the name stays and its arguments are scrubbed. ``scrub`` makes a column of a column."""
    p = prompts.withColumn("_name", F.when(F.col("is_command"), F.regexp_extract("text", r"^\S+", 0)).otherwise(""))
    p = p.withColumn("text", scrub(F.when(F.col("is_command"), T.strip(F.regexp_replace("text", r"^\S+", ""))).otherwise(F.col("text"))))
    return p.withColumn("text", T.strip(F.concat_ws(" ", F.nullif("_name", F.lit("")), "text"))).drop("_name")


def without_repeats(prompts: DataFrame, long: int = 1000, often: int = 5) -> DataFrame:
    """Prompts without those that repeat the one before and are an artefact.

    Dropped is a repeat that is the same row of the log, follows without an answer, is long, is repeated ``often`` times in
    one session and in no other, or is a tool's text. Counts of repeats cover the whole corpus; only repeats are counted
    and joined, the other prompts stay where they are.
    """
    w = _in_session()
    p = prompts.withColumn("_again", (F.col("text") != "") & F.coalesce(F.col("text") == F.lag("text").over(w), F.lit(False)))
    p = p.withColumn("_same", F.coalesce(F.col("turn_id") == F.lag("turn_id").over(w), F.lit(False)))
    again = p.where("_again")
    counts = again.groupBy("text", "session_id").agg(F.count(F.lit(1)).alias("n")).groupBy("text").agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_docs"))
    drop = F.col("_same") | ~F.col("agent_before") | (F.length("text") >= long) | T.is_scaffolding("text") | ((F.col("_n") >= often) & (F.col("_docs") == 1))
    kept = again.join(counts, "text").where(~drop).drop("_n", "_docs")
    return p.where("not _again").unionByName(kept).drop("_again", "_same")


def surviving_repeats(docs: DataFrame, key: str = "doc_id", turns: str = "turns") -> DataFrame:
    """``longest, scaffolding``: over turns equal to the one before, the greatest length and how many are a tool's texts."""
    pairs = F.filter(F.arrays_zip(F.slice(turns, 1, F.greatest(F.size(turns) - 1, F.lit(0))).alias("a"), F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0))).alias("b")), lambda x: (x["a"] == x["b"]) & (x["b"] != ""))
    each = docs.where(F.size(turns) > 1).select(F.explode(pairs).alias("x")).select(F.col("x.b").alias("t"))
    return each.agg(F.coalesce(F.max(F.length("t")), F.lit(0)).alias("longest"), F.coalesce(F.sum(T.is_scaffolding("t").cast("bigint")), F.lit(0)).alias("scaffolding"))


def session_turns(log: DataFrame, scrub=None) -> DataFrame:
    """The human, cleaned, unrepeated prompts of a log: ``session_id, turn_number, turn_id, text`` and the log's columns."""
    once = B.latest_delivery(log.where(F.col("session_id").isNotNull()))
    kept = human_prompts(merged_markdown(user_prompts(once))).where("reason is null")
    # written once: what follows reads the scrubbed texts three times
    return without_repeats(cut(clean_prompts(kept, scrub or scrub_prompt)).where("text <> ''"))


def scrub_prompt(text: Column) -> Column:
    """White space made regular and identifiers replaced by placeholders."""
    return T.clean_prompt(text)
