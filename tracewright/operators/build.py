"""From raw logs to the document table: sessions, identities, deduplication, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

AGENT_TURNS = ("assistant_response", "agent_message", "tool_call")


# --- deduplication ------------------------------------------------------------------------------------------------------
def exact_dedup(df: DataFrame, identity: str, text: str, *order: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The earliest row of each identity and text (nulls are equal).

    Rows meet by a hash of the text, so that one identity with a third of the rows doesn't meet in one task; of a text that
    is repeated without end each task keeps its earliest row before the exchange (the plan's partial window limit).
    """
    keys = [identity, F.xxhash64(F.col(text)), text, *extra]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def _affix(text: str, n: int, side: str) -> Column:
    t = F.col(text)
    part = F.substring(t, 1, n) if side == "prefix" else F.substring(t, -n, n)
    return F.when(F.length(t) >= n, part)


def drop_shared_affixes(df: DataFrame, identity: str, text: str, n: int = 100) -> DataFrame:
    """Rows whose first or last ``n`` characters no other identity uses; shorter and null texts stay. Null identities don't count.

    Only long texts take part in the exchanges: the others have no affix and would all meet under one key.
    """
    long_ = F.coalesce(F.length(text) >= n, F.lit(False))
    out = df.where(long_).withColumn("_p", F.xxhash64(_affix(text, n, "prefix"))).withColumn("_s", F.xxhash64(_affix(text, n, "suffix")))
    rows = out.where(F.col(identity).isNotNull())
    for c in ("_p", "_s"):
        # counted on the same rows for both, with partial aggregation: a hot affix is reduced before it is shuffled
        shared = rows.groupBy(F.col(c).alias("_k")).agg(F.min(identity).alias("_a"), F.max(identity).alias("_b"))
        out = out.join(shared.where(F.col("_a") != F.col("_b")).select("_k"), F.col(c) == F.col("_k"), "left_anti")
    return out.drop("_p", "_s").unionByName(df.where(~long_))


def cap_affixes(df: DataFrame, identity: str, text: str, *order: str, n: int = 100, most: int = 2) -> DataFrame:
    """At most ``most`` earliest rows of an identity for each prefix and for each suffix; both ranks on the same rows.

    Short, null and unidentified texts stay and take no part. The two ranks are limits of their own, so that a prefix with
    a third of the rows is cut to ``most`` in every task before it is shuffled; rows that pass both meet by what orders them.
    """
    takes = F.coalesce((F.length(text) >= n) & F.col(identity).isNotNull(), F.lit(False))
    rows = df.where(takes).withColumn("_t", F.xxhash64(text)).withColumn("_p", F.xxhash64(_affix(text, n, "prefix"))).withColumn("_s", F.xxhash64(_affix(text, n, "suffix")))
    first = lambda d, key: d.withColumn("_r", F.row_number().over(Window.partitionBy(identity, key).orderBy(*order, "_t"))).where(F.col("_r") <= most).drop("_r")
    also = first(rows.select(identity, "_s", "_t", *[c for c in order if c not in (identity, "_s", "_t")]), "_s")
    on = ["_t", identity, *[c for c in order if c != identity]]
    a, b = first(rows, "_p").alias("a"), also.alias("b")
    both = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in on], "left_semi").drop("_t", "_p", "_s")
    return both.unionByName(df.where(~takes))


def deduplicate(df: DataFrame, identity: str, text: str, *order: str, n: int = 100, most: int | None = 2, affixes: bool = True) -> DataFrame:
    """Exact duplicates, then affixes shared by identities, then the cap within an identity."""
    out = exact_dedup(df, identity, text, *order)
    if affixes:
        out = drop_shared_affixes(out, identity, text, n)
        if most is not None:
            out = cap_affixes(out, identity, text, *order, n=n, most=most)
    return out


def deduplicate_unidentified(df: DataFrame, doc_id: str, text: str, *order: str, n: int = 100) -> DataFrame:
    """Without identities: exact duplicates anywhere, then affixes shared by documents."""
    once = exact_dedup(df.withColumn("_all", F.lit("")), "_all", text, *order)
    return drop_shared_affixes(once, doc_id, text, n).drop("_all")


# --- filters ------------------------------------------------------------------------------------------------------------
def min_docs(df: DataFrame, author: str, least: int) -> DataFrame:
    """Rows of authors with at least ``least`` rows; null authors are left out."""
    kept = df.groupBy(author).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(author)
    return df.join(kept, author, "left_semi")


def relay_authors(df: DataFrame, author: str = "author_id", turns: str = "turns", n_turns: str = "num_turns", least: int = 2) -> DataFrame:
    """Authors with scaffolding in ``least`` documents or more and single-turn documents only."""
    per = df.where(F.col(author).isNotNull()).groupBy(author).agg(
        F.sum(T.has_chat_scaffolding(turns).cast("int")).alias("scaffold"), F.every(F.coalesce(F.col(n_turns) == 1, F.lit(False))).alias("single")
    )
    return per.where((F.col("scaffold") >= least) & F.col("single")).select(author)


def drop_relays(df: DataFrame, author: str = "author_id", **named) -> DataFrame:
    return df.join(relay_authors(df, author, **named), author, "left_anti")


def uniquify(df: DataFrame, id_col: str, *order: str) -> DataFrame:
    """Repeated ids get ``-1``, ``-2``, … in order."""
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(*order)) - 1
    return df.withColumn(id_col, F.when(n > 0, F.concat(F.col(id_col), F.lit("-"), n)).otherwise(F.col(id_col)))


# --- votes --------------------------------------------------------------------------------------------------------------
def ordered_languages(df: DataFrame, key: str, lang: str, *order: str) -> DataFrame:
    """``key, languages``: the most frequent first (ties: first seen), the others sorted; nulls don't count."""
    c = df.where(F.col(lang).isNotNull()).groupBy(key, lang).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("at"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "at", lang)).alias("best")
    got = c.groupBy(key).agg(best, F.array_sort(F.collect_set(lang)).alias("all"))
    first = F.col(f"best.{lang}")
    return got.select(key, F.concat(F.array(first), F.filter("all", lambda x: x != first)).alias("languages"))


def dominant_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """``key, value``: the most frequent value, the smallest on ties; null, blank, ``none`` and ``nan`` don't count."""
    real = df.where(F.col(value).isNotNull() & ~F.lower(F.trim(value)).isin("", "none", "nan"))
    c = real.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("b")).select(key, F.col(f"b.{value}").alias(value))


def recover_identity(sessions: DataFrame, user: str = "user_id", repo: str = "repo_id") -> DataFrame:
    """``identity``: the user; without one the repository's only user, else the repository where no user is known, else null."""
    u = F.when(F.lower(F.col(user)) != "nan", F.col(user))
    per = sessions.where(u.isNotNull() & F.col(repo).isNotNull()).groupBy(repo).agg(F.min(u).alias("_lo"), F.max(u).alias("_hi"))
    out = sessions.join(per, repo, "left")
    sole = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
    return out.withColumn("identity", F.coalesce(u, F.when(F.col("_lo").isNull(), F.col(repo)).otherwise(sole))).drop("_lo", "_hi")


# --- turn logs ----------------------------------------------------------------------------------------------------------
def latest_delivery(log: DataFrame, key: str = "turn_id", loaded: str = "loaded_at") -> DataFrame:
    """One row for each turn however often and late it was delivered; rows without a key stay, and take no part in the exchange."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(loaded), F.xxhash64("session_id", "turn_number")))
    once = log.where(F.col(key).isNotNull()).withColumn("_r", r).where("_r = 1").drop("_r")
    return once.unionByName(log.where(F.col(key).isNull()))


def agent_turns_before(log: DataFrame, session: str = "session_id", number: str = "turn_number", kind: str = "turn_type", content: str = "content") -> DataFrame:
    """The log with ``cum_agent``: answers of the agent before each turn of its session, failed ones left out."""
    agent = F.col(kind).isin(*AGENT_TURNS) & ~((F.col(kind) == "assistant_response") & T.is_error_response(content))
    w = Window.partitionBy(session).orderBy(number, F.xxhash64(kind, content)).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("cum_agent", F.coalesce(F.sum(agent.cast("int")).over(w), F.lit(0)).cast("bigint"))


def markdown_runs(turns: DataFrame, session: str = "session_id", number: str = "turn_number", text: str = "content") -> DataFrame:
    """Consecutive prompts that open with ``#`` and have no agent turn between them become one; gaps and islands.

    ``turns`` has the prompts with ``cum_agent``; gives ``session, number, text, n_merged``.
    """
    w = Window.partitionBy(session).orderBy(number)
    md = F.coalesce(F.ltrim(F.col(text)).startswith("#"), F.lit(False))
    joins = md & F.coalesce(F.lag(md).over(w), F.lit(False)) & (F.col("cum_agent") == F.lag("cum_agent").over(w))
    island = F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = turns.withColumn("_joins", joins).withColumn("_island", island).groupBy(session, "_island").agg(
        F.min(number).alias(number), F.array_sort(F.collect_list(F.struct(number, text))).alias("_all")
    )
    return runs.select(session, number, F.array_join(F.transform("_all", lambda x: x[text]), "\n\n").alias(text), F.size("_all").cast("bigint").alias("n_merged"))


def consecutive_duplicates(turns: DataFrame, doc: str, number: str, text: str) -> DataFrame:
    """``text, extra, docs``: how often a turn follows itself, over the whole corpus, and in how many documents."""
    w = Window.partitionBy(doc).orderBy(number)
    again = turns.where(F.col(text).isNotNull()).withColumn("_again", F.col(text) == F.lag(text).over(w)).where("_again")
    return again.groupBy(text).agg(F.count(F.lit(1)).alias("extra"), F.countDistinct(doc).alias("docs"))


def session_documents(log: DataFrame, source: str = "swe-chat") -> DataFrame:
    """Turn log to documents, one for each session with a human turn.

    Repeated deliveries count once; prompts are merged, filtered to what humans typed, scrubbed of identifiers and of the
    session's own repository and user names, and cleared of artefact repeats (:mod:`.sessions`); columns are ``doc_id, source,
    identity, turns, num_turns, language_primary, language_secondary, model, model_owner, agent, started_at, ended_at``.
    """
    from .sessions import session_turns

    once = latest_delivery(log.where(F.col("session_id").isNotNull()))
    model = dominant_value(once, "session_id", "model")
    prompts = session_turns(log, lambda c: T.clean_prompt(c, repo_id=F.col("repo_id"), user_id=F.col("user_id"))).withColumn("_text", F.col("text"))
    lang = ordered_languages(prompts.withColumn("_l", T.normalize_language("turn_language")), "session_id", "_l", "turn_number", "turn_id")
    docs = prompts.groupBy("session_id").agg(
        F.min_by("user_id", F.struct("turn_number", "turn_id")).alias("user_id"),
        F.min_by("repo_id", F.when(F.col("repo_id").isNotNull(), F.struct("turn_number", "turn_id"))).alias("repo_id"),
        F.min_by("agent", F.struct("turn_number", "turn_id")).alias("agent"),
        F.min("turn_timestamp").alias("started_at"),
        F.max("turn_timestamp").alias("ended_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "turn_id", "_text"))), lambda x: x["_text"]).alias("turns"),
    )
    docs = recover_identity(docs).where(F.col("identity").isNotNull()).join(model, "session_id", "left").join(lang, "session_id", "left")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return docs.select(
        F.concat(F.lit("sc-"), "session_id").alias("doc_id"),
        F.lit(source).alias("source"),
        "identity",
        "turns",
        F.size("turns").alias("num_turns"),
        F.get("languages", F.lit(0)).alias("language_primary"),
        F.get("languages", F.lit(1)).alias("language_secondary"),
        F.coalesce("model", F.lit("<no_model>")).alias("model"),
        T.model_owner("model").alias("model_owner"),
        "agent",
        iso("started_at").alias("started_at"),
        iso("ended_at").alias("ended_at"),
    )


# --- identities in time -------------------------------------------------------------------------------------------------
def interval_pairs(df: DataFrame, block: list[str], max_gap_days: float = 30.0, max_block: int = 50) -> DataFrame:
    """Pairs of authors of a block whose intervals don't overlap and lie at most ``max_gap_days`` apart.

    ``df`` has ``author_id, first_seen, last_seen, n_docs, state`` and the block's columns. Rows with a null author or time
    are left out, null block values are no value. A block is held to ``max_block`` rows by rule (a larger one says nothing),
    so no pair of it is ever made.
    """
    rows = df.where(F.col("author_id").isNotNull() & F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull())
    rows = rows.select("author_id", "first_seen", "last_seen", "n_docs", "state", *[F.col(c).alias(f"_b{i}") for i, c in enumerate(block)]).distinct()
    key = [f"_b{i}" for i in range(len(block))]
    rows = rows.dropna(subset=key)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("block_size")).where(F.col("block_size").between(2, max_block))
    rows = rows.join(sizes, key)
    a, b = rows.alias("a"), rows.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    gap = (F.unix_micros("b.first_seen") - F.unix_micros("a.last_seen")) / 86_400_000_000.0
    pairs = a.join(b, [*same, F.col("b.first_seen") >= F.col("a.last_seen"), gap <= max_gap_days, F.col("a.author_id") != F.col("b.author_id")])
    return pairs.select(
        F.col("a.author_id").alias("a"), F.col("b.author_id").alias("b"), F.round(gap, 2).alias("gap_days"), F.col("a.block_size").alias("block_size"),
        F.col("a.n_docs").alias("n_a"), F.col("b.n_docs").alias("n_b"), F.col("a.state").eqNullSafe(F.col("b.state")).alias("same_state"),
    )


def nearest_time_pairs(df: DataFrame, key: str, ident: str, ts: str, window: float = 600.0, most_ids: int = 3) -> DataFrame:
    """``a, b, seconds``: identities that share a key held by 2 to ``most_ids`` of them, their nearest times within ``window``."""
    rows = df.where(F.col(key).isNotNull() & F.col(ident).isNotNull() & F.col(ts).isNotNull()).select(key, ident, ts)
    few = rows.groupBy(key).agg(F.countDistinct(ident).alias("_n")).where(F.col("_n").between(2, most_ids)).select(key)
    rows = rows.join(few, key)
    # the nearest time of another identity is a neighbour in time order: one sort, no pairs of a group
    w = Window.partitionBy(key).orderBy(ts, ident)
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    rows = rows.withColumn("_t", t)
    ids = rows.groupBy(key).agg(F.array_sort(F.collect_set(ident)).alias("_ids"))  # no more than most_ids
    rows = rows.join(ids, key)
    seen = [F.last(F.when(F.col(ident) == F.get("_ids", F.lit(i)), F.col("_t")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for i in range(most_ids)]
    near = F.array(*[F.struct(F.get("_ids", F.lit(i)).alias("other"), (F.col("_t") - s).alias("gap")) for i, s in enumerate(seen)])
    near = rows.withColumn("_near", near).select(ident, F.explode("_near").alias("x")).where(F.col("x.gap").isNotNull() & (F.col("x.other") != F.col(ident)) & (F.col("x.gap") <= window))
    return near.groupBy(F.least(ident, "x.other").alias("a"), F.greatest(ident, "x.other").alias("b")).agg(F.min("x.gap").alias("seconds"))


# --- reports ------------------------------------------------------------------------------------------------------------
def summarize(df: DataFrame, source: str = "source", author: str = "author_id", turns: str = "num_turns") -> DataFrame:
    """Documents, authors and turns of each source and of all (``source`` is null there)."""
    q = lambda x: F.percentile(turns, F.lit(x))
    return df.rollup(source).agg(
        F.count(F.lit(1)).alias("docs"), F.countDistinct(author).alias("authors"), F.avg(turns).alias("mean_turns"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"),
        F.grouping(source).cast("bigint").alias("is_total"),
    )


def violations(df: DataFrame) -> DataFrame:
    """``rule, n``: rows of a document table that break a rule of the canonical schema."""
    n_turns = F.size(F.coalesce("turns", F.array().cast("array<string>")))
    rules: dict[str, Callable[[], Column]] = {
        "doc_id is null": lambda: F.col("doc_id").isNull(),
        "turns are null or empty": lambda: n_turns == 0,
        "num_turns isn't the number of turns": lambda: ~F.coalesce(F.col("num_turns") == n_turns, F.lit(False)),
        "a turn is null or blank": lambda: F.coalesce(F.exists("turns", lambda t: t.isNull() | (T.strip(t) == "")), F.lit(False)),
        "language_primary is null": lambda: F.col("language_primary").isNull(),
        "ended before started": lambda: F.coalesce(F.col("ended_at") < F.col("started_at"), F.lit(False)),
        "started_at isn't a time": lambda: F.col("started_at").isNotNull() & F.col("started_at").try_cast("timestamp").isNull(),
        "ended_at isn't a time": lambda: F.col("ended_at").isNotNull() & F.col("ended_at").try_cast("timestamp").isNull(),
        "only one of both times": lambda: F.col("started_at").isNull() != F.col("ended_at").isNull(),
        "source is null or blank": lambda: F.coalesce(T.strip("source") == "", F.lit(True)),
        "author_id is blank": lambda: F.coalesce(T.strip("author_id") == "", F.lit(False)),
        "author_id isn't of its source": lambda: F.coalesce(~F.col("author_id").startswith(F.concat(F.col("source"), F.lit("-"))), F.lit(False)),
        "languages are equal": lambda: F.coalesce(F.col("language_primary") == F.col("language_secondary"), F.lit(False)),
        "a second language without a first": lambda: F.col("language_primary").isNull() & F.col("language_secondary").isNotNull(),
        "language_primary isn't in title case": lambda: F.coalesce(F.col("language_primary") != F.initcap("language_primary"), F.lit(False)),
        "model is null or blank": lambda: F.coalesce(T.strip("model") == "", F.lit(True)),
        "model_owner isn't the model's": lambda: ~F.coalesce(F.col("model_owner") == T.model_owner("model"), F.lit(False)),
        "a turn holds an address": lambda: F.coalesce(F.exists("turns", lambda t: t.rlike(r"https?://\S")), F.lit(False)),
        "a turn holds an email": lambda: F.coalesce(F.exists("turns", lambda t: t.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")), F.lit(False)),
        "a turn ends in blanks": lambda: F.coalesce(F.exists("turns", lambda t: t.rlike(r"[ \t](?:\n|$)")), F.lit(False)),
        "a turn has three empty lines": lambda: F.coalesce(F.exists("turns", lambda t: t.contains("\n\n\n")), F.lit(False)),
        "a turn is a tool's text": lambda: F.coalesce(F.exists("turns", lambda t: T.is_scaffolding(t)), F.lit(False)),
        "a turn repeats the one before": lambda: F.coalesce(F.size(F.filter(F.arrays_zip(F.slice("turns", 1, F.greatest(n_turns - 1, F.lit(0))).alias("a"), F.slice("turns", 2, F.greatest(n_turns - 1, F.lit(0))).alias("b")), lambda x: x["a"] == x["b"])) > 0, F.lit(False)),
        "chat labels in the turns": lambda: T.has_chat_scaffolding("turns"),
    }
    # a rule over a column that isn't there is left out
    needs = {
        "num_turns": ("num_turns",), "language": ("language_primary",), "second language": ("language_secondary",), "are equal": ("language_secondary",), "started": ("started_at",), "ended": ("ended_at", "started_at"),
        "both times": ("started_at", "ended_at"), "source": ("source",), "model is": ("model",), "model_owner": ("model", "model_owner"), "author": ("author_id",), "isn't of its source": ("source", "author_id"),
    }
    here = lambda rule: all(c in df.columns for words, cols in needs.items() if words in rule for c in cols)
    rules = {r: f() for r, f in rules.items() if here(r)}
    one = df.agg(*[F.sum(c.cast("bigint")).alias(r) for r, c in rules.items()])
    repeated = df.groupBy("doc_id").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n"))
    listed = one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"`{r}`"), F.lit(0)).alias("n")) for r in rules])).alias("x")).select("x.rule", "x.n")
    has = lambda *c: all(x in df.columns for x in c)
    alone = None if not has("author_id") else df.where(F.col("author_id").isNotNull()).groupBy("author_id").agg(F.countDistinct("doc_id").alias("c")).where("c < 2").agg(F.count(F.lit(1)).alias("n"))
    shared = None if not has("author_id", "source") else df.where(F.col("author_id").isNotNull()).groupBy("author_id").agg(F.countDistinct("source").alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
    twice = None if not has("author_id") else df.where(n_turns > 0).groupBy("author_id", F.xxhash64("turns").alias("h")).agg(F.countDistinct("doc_id").alias("c")).where("c > 1").agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    more = {"doc_id is repeated": repeated, "an author has one document": alone, "an author has several sources": shared, "an author's turns are repeated": twice}
    for rule, d in more.items():
        if d is None:
            continue
        listed = listed.unionByName(d.select(F.lit(rule).alias("rule"), "n"))
    return listed


def language_table(df: DataFrame, source: str = "source", lang: str = "language_primary", most: int = 12) -> DataFrame:
    """``source, language, n, rank``: the most frequent languages of each source (a top-k report); null languages don't count."""
    c = df.where(F.col(lang).isNotNull()).groupBy(F.col(source).alias("source"), F.col(lang).alias("language")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "language"))).where(F.col("rank") <= most)
