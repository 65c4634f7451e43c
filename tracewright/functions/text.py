"""Cleaning, scrubbing and describing texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scrub placeholders.
PLACEHOLDERS = ("<URL>", "<EMAIL>", "<IP>", "<PATH>", "<REPO>", "<USER>", "<ID>", "<HOST>")
#: Repository words too common to scrub.
COMMON_REPO_WORDS = (
    "agent app cli site api web core sdk docs data main code dev bot chat tool tools server client backend frontend utils common config demo example"
    " examples test tests www lib ui repo path url user email ip"
).split()
#: Function words whose frequencies are features.
FUNCTION_WORDS = (
    "the a an and but or if because of to in on at with however although actually just really very so then also that this these those which who what"
).split()

#: The patterns of identifiers.
_URL = r"(?i)https?://\S+|www\.\S+"
_EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
_IPV4 = r"(?U)(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)"
_HOST = (
    r"(?U)(?<![\w/@.\-])[A-Za-z0-9_][\w.+\-]*@(?!(?:v\d|main|master|latest|stable|beta|alpha|next|canary|nightly|edge|release|dev|prod|staging|HEAD|head)(?![\w.\-]))"
    r"[A-Za-z][A-Za-z0-9\-]*(?![\w.\-])"
)
# a token of digits joined by / - . : is a date, a fraction or a range and stays
_PATH = (
    r"(?U)(?<!\w)(?!\d+(?:[/\-.:]\d+)+(?![\w.\-/]))(?:[A-Za-z]:\\\S+|~/[\w.\-][\w.\-/]*|/[\w.\-]+/[\w.\-/]*|[\w.\-]+/[\w.\-]+/[\w.\-/]+|[\w.\-]+/[\w.\-/]*\.[A-Za-z0-9]{1,6})"
)
_UUID = r"(?U)(?<![\w-])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![\w-])"
_HASH = r"(?U)(?<![\w-])(?!(?i:ed25519)(?![\w-]))(?:[0-9a-fA-F]{32,}|(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{7,31})(?![\w-])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalize_whitespace(text) -> Column:
    """Escaped newlines and carriage returns to newlines, blanks before newlines off, at most one empty line; null stays null."""
    t = F.replace(_c(text), F.lit("\\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def strip(text) -> Column:
    """White space off both ends."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def scrub_urls(text) -> Column:
    return F.regexp_replace(_c(text), _URL, " <URL> ")


def scrub_emails(text) -> Column:
    return F.regexp_replace(_c(text), _EMAIL, " <EMAIL> ")


def scrub_ips(text) -> Column:
    return F.regexp_replace(_c(text), _IPV4, " <IP> ")


def scrub_paths(text) -> Column:
    return F.regexp_replace(_c(text), _PATH, " <PATH> ")


def scrub_ids(text) -> Column:
    """UUIDs and hex runs that look like hashes: 32 digits or more, or 7 to 31 with a letter and a digit."""
    return F.regexp_replace(F.regexp_replace(_c(text), _UUID, " <ID> "), _HASH, " <ID> ")


def _scrub_token(text: Column, token: Column, placeholder: str, least: int = 1, guard: bool = False) -> Column:
    ok = F.length(token) >= least
    if guard:
        ok = ok & ~F.lower(token).isin(COMMON_REPO_WORDS)
    pattern = F.concat(F.lit("(?iU)(?<!\\w)"), F.regexp_replace(token, r"([^A-Za-z0-9 ])", "\\\\$1"), F.lit("(?!\\w)"))
    # one reference to the text, however many tokens are scrubbed one after the other: a pattern that never matches where there is none
    return F.regexp_replace(text, F.when(F.coalesce(ok, F.lit(False)), pattern).otherwise(F.lit("(?!)")), F.lit(f" {placeholder} "))


def scrub_identifiers(text, repo_id=None, user_id=None, mask_ids: bool = False) -> Column:
    """URLs, emails, addresses of machines, paths, and the row's own repository and user names become placeholders.

    Null texts become empty; null, blank and ``nan`` names are left out. ``mask_ids`` also masks logins and opaque ids.
    """
    t = scrub_emails(scrub_urls(F.coalesce(_c(text), F.lit(""))))
    if mask_ids:
        t = F.regexp_replace(t, _HOST, " <HOST> ")
    t = scrub_paths(scrub_ips(t))
    if mask_ids:
        t = scrub_ids(t)
    for name, mark, cutter in ((repo_id, "<REPO>", "/"), (user_id, "<USER>", "@")):
        if name is None:
            continue
        n = F.trim(_c(name))
        n = F.when((n != "") & (F.lower(n) != "nan"), n)
        a = F.split(n, cutter)[0]
        b = F.get(F.split(n, cutter), F.lit(1)) if cutter == "/" else F.lit(None).cast("string")
        t = _scrub_token(t, n, mark)
        long_, short = F.when(F.length(a) >= F.coalesce(F.length(b), F.lit(0)), a).otherwise(b), F.when(F.length(a) >= F.coalesce(F.length(b), F.lit(0)), b).otherwise(a)
        t = _scrub_token(t, long_, mark, 3, guard=True)
        t = _scrub_token(t, short, mark, 3, guard=True)
    t = F.regexp_replace(t, r"(?<=\S)[ \t]{2,}", " ")
    return strip(F.regexp_replace(t, r"[ \t]+(?=\n)", ""))


def clean_prompt(text, **names) -> Column:
    return scrub_identifiers(normalize_whitespace(text), **names)


def strip_redactions(text) -> Column:
    """Marks of redaction by an earlier publisher removed."""
    return F.regexp_replace(_c(text), r"<REDACTED>|<DATE_TIME>", "")


def last_segment(url) -> Column:
    """Last part of a URL's path without query and fragment."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(_c(url), r"[?#].*$", ""), r"/+$", ""), "/"), -1)


def model_owner(model) -> Column:
    """Organisation that serves a model; ``unknown`` for missing and other names."""
    m = F.lower(_c(model))
    return (
        F.when(m.isNull() | m.isin("", "none", "nan", "<no_model>"), "unknown")
        .when(m.startswith("claude"), "Anthropic")
        .when(m.startswith("gpt") | m.startswith("chatgpt") | m.contains("codex"), "OpenAI")
        .when(m.startswith("gemini"), "Google")
        .when(m.startswith("glm"), "Zhipu")
        .when(m.startswith("reka"), "Reka")
        .when(m.startswith("yi-vision"), "01.AI")
        .otherwise("unknown")
    )


def normalize_language(name) -> Column:
    """Trimmed name in title case; null for null, blank, ``nan`` and ``none``."""
    n = strip(name)
    return F.when(~F.lower(n).isin("", "nan", "none"), F.initcap(n))


def hash_author_id(source, identity, salt: str = "") -> Column:
    """``source-`` and 16 hexadecimal digits of the SHA-256 of salt, source and identity; null identities stay null."""
    s = _c(source)
    return F.concat(s, F.lit("-"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), s, F.lit("|"), _c(identity)), 256), 1, 16))


def identity_key(ip, language, device) -> Column:
    return F.concat_ws("|", *[F.coalesce(_c(x), F.lit("")) for x in (ip, language, device)])


def is_error_response(text) -> Column:
    t = F.coalesce(_c(text), F.lit(""))
    return F.ltrim(t).startswith("API Error") | t.contains('"type":"error"')


#: Openings of messages that coding agents inject.
_SCAFFOLD = (
    r"(?i)^\[Request interrupted by user|^\[Image:|^Tool loaded\.$|^Summarize the task tool output above|^Continue from where you left off\.$|^Base directory for this skill:"
    r"|^Caveat: The messages below|Execute the following steps non-interactively|Optionally specify a change name after|<command-message>|<command-name>|<command-args>"
    r"|<bash-input>|<bash-stdout>|<bash-stderr>|<local-command|<manually_attached_skills>"
)


def is_scaffolding(text) -> Column:
    return F.coalesce(_c(text), F.lit("")).rlike(_SCAFFOLD)


#: What marks a turn that a tool put in, with the reason it gives; the first line that fits counts.
INJECTED = (
    ("tool-io", "begins", ("<task-notification>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "<ide_", "<local-command")),
    ("tool-io", "holds", ("<task-notification>", "</task-notification>")),
    ("env-context", "holds", ("<environment_context>",)),
    ("orchestration", "begins", ("[OMX", "You are OMX Explore")),
    ("orchestration", "holds", ("[OMX_TMUX_INJECT]",)),
    ("compaction", "begins in any case", ("this session is being continued", "caveat: the messages below")),
    ("plan-mode", "begins", ("Implement the following plan",)),
    ("skill-body", "begins", ("Base directory for this skill:",)),
    ("skill-body", "holds", ("<manually_attached_skills>", "Execute the following steps non-interactively")),
    ("skill-body", "begins", ("You are a code reviewer. Your job is to review code changes",)),
)
#: Wrappers and templates taken out of a turn, as patterns of both regular-expression dialects.
WRAPPERS = (
    r"(?is)<system[_-]instruction>.*?</system[_-]instruction>|<teammate-message\b[^>]*>.*?</teammate-message>",
    r"(?is)<(?:system[_-]instruction|teammate-message)\b.*",
    r"(?s)^You are OMX Explore\b.*?User request:(?:\s|\\n)*",
)
REVIEW = r"(?s)^You are a code reviewer\. Your job is to review code changes\b.*?Input:\s*(.*?)\s*---"
REMINDER = r"(?is)IT IS CRITICAL THAT YOU FOLLOW THIS COMMAND: LOAD the FULL \{project-root\}.*?READ its entire contents and follow its directions exactly!"
LEADING = r"^(?:(?:\[Request interrupted[^\]]*\]|\[Image:[^\]]*\])\s*)+"
CONTINUES = r"^(?:#{1,6}\s|\*\*|\||\d+[.)]\s|[-*]\s|```|>|\{)"


def nonhuman_reason(text, longest: int = 8000) -> Column:
    """Why a turn isn't written by a human, or null; the first rule that fits counts."""
    t = F.coalesce(_c(text), F.lit(""))
    s = F.regexp_replace(t, r"(?U)^\s+", "")
    tests = {"begins": lambda x: s.startswith(x), "begins in any case": lambda x: F.lower(s).startswith(x), "holds": lambda x: t.contains(x)}
    out = F.when(t == "", "empty")
    for reason, how, texts in INJECTED:
        out = out.when(F.greatest(*[tests[how](x) for x in texts], F.lit(False)), reason)
    out = out.when(is_scaffolding(s), "scaffolding").when((s.startswith("#") | s.startswith("**")) & s.contains("\n\n"), "markdown-body")
    return out.when(F.length(t) >= longest, "too-long")


def strip_wrappers(text) -> Column:
    """A turn without injected wrappers, personas, reminders and leading markers; what a human wrote around them stays."""
    t = F.coalesce(_c(text), F.lit(""))
    for p in WRAPPERS:
        t = F.regexp_replace(t, p, "")
    t = F.when(t.rlike(REVIEW), F.regexp_extract(t, REVIEW, 1)).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, REMINDER, ""), r"^\s+", ""), LEADING, "")
    return strip(t)


def continues(text, least: int = 500) -> Column:
    """Whether a turn opens like a piece of a document, or is long."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.regexp_replace(t, r"^\s+", "").rlike(CONTINUES) | (F.length(t) >= least)


def is_command_body(text) -> Column:
    """Whether a turn is the body of a skill or a command that a tool put in."""
    t = F.coalesce(_c(text), F.lit(""))
    return t.startswith("Base directory for this skill:") | t.contains("<manually_attached_skills>") | t.contains("Execute the following steps non-interactively")


def sample_prompt(text, most: int = 160) -> Column:
    """The beginning of a text with single blanks."""
    return F.substring(F.regexp_replace(_c(text), r"\s+", " "), 1, most)


#: User agents of programs.
_MALFORMED_AGENT = r"(?i)^\s*(?:user-?agent|accept(?:-language|-encoding)?|host|referer|connection)\s*[:=]"
_PROGRAM_AGENT = (
    r"(?i)\b(?:python|python-requests|python-httpx|httpx|aiohttp|urllib|requests|curl|libcurl|wget|okhttp|axios|node|node-fetch|undici|bun|deno|go-http-client|java|jakarta|apache-httpclient|httpclient|dart|guzzle"
    r"|libwww-perl|lwp|restsharp|scrapy|postmanruntime|insomnia|reqwest|ktor|gradio_client|gradio_client_php|huggingface_hub|hf_hub|openai|langchain|dalvik|cpp-httplib|headlesschrome|phantomjs|selenium|puppeteer"
    r"|playwright|bot|crawler|spider|scraper)\b"
)
PROGRAM_CLIENTS = (
    "adsbot-google-mobile", "axios", "bun", "chrome headless", "curl", "go-http-client", "google-read-aloud", "mozilla", "node-fetch", "okhttp", "postmanruntime", "python-httpx", "python-requests", "undici",
)


def is_program(agent, device) -> Column:
    """Whether a user agent is a program's: missing or malformed, named like a library, or without a browser in its device.

    ``device`` is what a parser made of it (``browser;system;device;cpu``), null where it isn't known.
    """
    a, d = _c(agent), _c(device)
    browser = F.lower(strip(F.element_at(F.split(d, ";"), 1)))
    bad = a.isNull() | (strip(a) == "") | F.regexp_replace(a, r"^\s+", "").startswith("{") | a.rlike(_MALFORMED_AGENT) | a.rlike(_PROGRAM_AGENT)
    return F.coalesce(bad, F.lit(True)) | F.coalesce(~d.contains(";"), F.lit(True)) | browser.isin(*PROGRAM_CLIENTS)


def json_object(text) -> Column:
    """A JSON object as a map with lower-case keys and the values' texts; null for anything else."""
    m = F.from_json(_c(text), "map<string,string>")
    return F.when(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"^\s+", "").startswith("{") & m.isNotNull(), F.map_from_entries(F.array_distinct(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))))


def apply_edits(text, edits) -> Column:
    """A text with pieces replaced; ``edits`` is an array of ``start, stop, new`` (from 0), null where two of them overlap."""
    e = F.array_sort(_c(edits))
    init = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(True).alias("fine"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(_c(text), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), x["new"]).alias("out"), x["stop"].cast("int").alias("at"), (acc["fine"] & (x["start"] >= acc["at"]) & (x["stop"] >= x["start"])).alias("fine")
    )
    done = F.aggregate(e, init, step)
    whole = F.concat(done["out"], F.substring(_c(text), done["at"] + 1, F.length(_c(text))))
    return F.when(e.isNull() | (F.size(e) == 0), _c(text)).when(done["fine"], whole)


def normalize_command(text):
    """A turn that is a pure command block as ``/name args``, else the turn; and whether it was one."""
    t = F.coalesce(_c(text), F.lit(""))
    inner = F.regexp_replace(t, r"(?s)<command-(name|message|args)>.*?</command-\1>", "")
    pure = t.contains("<command-name>") & (strip(inner) == "")
    name = strip(F.regexp_extract(t, r"(?s)<command-name>(.*?)</command-name>", 1))
    args = strip(F.regexp_extract(t, r"(?s)<command-args>(.*?)</command-args>", 1))
    slash = F.when(name.startswith("/"), name).otherwise(F.concat(F.lit("/"), name))
    return F.struct(F.when(pure, strip(F.concat_ws(" ", slash, F.when(args != "", args)))).otherwise(_c(text)).alias("text"), pure.alias("is_command"))


def has_chat_scaffolding(turns) -> Column:
    """A trailing label of the assistant or a leading label of the system in the joined turns."""
    t = F.array_join(_c(turns), "\n")
    return F.coalesce(t.rlike(r"(?i)^\s*(?:System|Assistant|AI|ChatGPT|Bot)\s*:\s") | t.rlike(r"(?i)(?:^|\n)\s*(?:Assistant|AI|ChatGPT|Bot)\s*:\s*$"), F.lit(False))


def words(text) -> Column:
    """Pieces between white space; none for null and blank texts."""
    t = strip(F.coalesce(_c(text), F.lit("")))
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")


def tokens(text) -> Column:
    """Lower-cased runs of word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def character_statistics(text) -> list[Column]:
    """Length; ratios of upper case, digits, white space and punctuation; mean word length; number of words."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    w = words(t)
    ratio = lambda rx: F.regexp_count(t, F.lit(rx)) / n
    return [
        F.length(t).cast("bigint").alias("n_chars_found"),
        ratio(r"\p{Lu}").alias("upper_ratio"),
        ratio(r"\p{Nd}").alias("digit_ratio"),
        ratio(r"(?U)\s").alias("space_ratio"),
        ratio(r"[!-/:-@\[-`{-~]").alias("punct_ratio"),
        F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(0.0).alias("mean_word_length"),
        F.size(w).cast("bigint").alias("n_words"),
    ]


def function_word_frequencies(text) -> list[Column]:
    """Share of each function word among the tokens of a text."""
    t = tokens(text)
    n = F.greatest(F.size(t), F.lit(1))
    equal = lambda w: lambda x: x == F.lit(w)
    return [(F.size(F.filter(t, equal(w))) / n).alias(f"fw_{w}") for w in FUNCTION_WORDS]


def latin_ratio(text) -> Column:
    """Latin letters among all letters; 1 without letters."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(n > 0, F.regexp_count(t, F.lit(r"\p{IsLatin}")) / n).otherwise(1.0)


def style_stats(text) -> list[Column]:
    """Mean word length, type-token ratio, words per sentence, punctuation density and upper-case ratio, rounded half to even."""
    t = F.coalesce(_c(text), F.lit(""))
    w, n = words(t), F.greatest(F.length(t), F.lit(1))
    k = F.greatest(F.size(w), F.lit(1))
    s = F.greatest(F.size(F.filter(F.split(t, r"[.!?]+"), lambda x: strip(x) != "")), F.lit(1))
    r = lambda c, name: F.bround(c, 4).alias(name)
    return [
        r(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / k, "avg_word_length"),
        r(F.size(F.array_distinct(F.transform(w, F.lower))) / k, "type_token_ratio"),
        r(F.size(w) / s, "words_per_sentence"),
        r(F.regexp_count(t, F.lit(r"[!-/:-@\[-`{-~]")) / n, "punct_density"),
        r(F.regexp_count(t, F.lit(r"\p{Lu}")) / n, "uppercase_ratio"),
    ]


def drop_empty_turns(turns) -> Column:
    """Turns that are neither null nor blank."""
    return F.filter(_c(turns), lambda t: t.isNotNull() & (strip(t) != ""))


def document_words(turns) -> Column:
    """Number of words of all turns."""
    return F.aggregate(F.coalesce(_c(turns), F.array().cast("array<string>")), F.lit(0), lambda a, t: a + F.size(words(t)))


def token_estimate(turns) -> Column:
    """A quarter of the characters of all turns, rounded half to even."""
    chars = F.aggregate(F.coalesce(_c(turns), F.array().cast("array<string>")), F.lit(0), lambda a, t: a + F.coalesce(F.length(t), F.lit(0)))
    return F.bround(chars / 4.0).cast("bigint")


def cap_turns(turns, most: int, mark: str = " […]") -> Column:
    """Whole turns as long as their characters stay within ``most``; a first turn that is longer is cut and marked."""
    init = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))
    step = lambda a, t: F.when(
        ~a["full"] & (a["used"] + F.length(t) <= most), F.struct(F.concat(a["kept"], F.array(t)).alias("kept"), (a["used"] + F.length(t)).alias("used"), F.lit(False).alias("full"))
    ).otherwise(F.struct(a["kept"].alias("kept"), a["used"].alias("used"), F.lit(True).alias("full")))
    t = drop_empty_turns(turns)
    kept = F.aggregate(t, init, step)["kept"]
    return F.when(F.size(kept) > 0, kept).when(F.size(t) > 0, F.array(F.concat(F.substring(t[0], 1, most), F.lit(mark)))).otherwise(kept)


def strip_for_detection(text) -> Column:
    """Code, placeholders, commands and mentions removed, white space collapsed."""
    t = F.coalesce(_c(text), F.lit(""))
    for rx in (r"(?s)```.*?(?:```|$)", r"`[^`]*`", r"<[A-Z]+>", r"(?:^|(?<=\s))/[A-Za-z][\w:-]*", r"(?:^|(?<=\s))@\S+"):
        t = F.regexp_replace(t, rx, " ")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def script_share(text, script: str) -> Column:
    """Share of the letters that belong to a script; 0 without letters."""
    t = F.coalesce(_c(text), F.lit(""))
    n = F.regexp_count(t, F.lit(r"\p{L}"))
    return F.when(n > 0, F.regexp_count(t, F.lit(rf"\p{{Is{script}}}")) / n).otherwise(0.0)


def normalise_style(text) -> Column:
    """Lower case, ASCII punctuation removed, white space collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def ngram_reuse(original, rewritten, n: int = 8) -> Column:
    """Share of the distinct word n-grams of the original that the rewritten text still has; 0 for texts that are too short."""
    def grams(x):
        # the words are bound once, as the only element of an array, instead of being found again for each n-gram
        at = lambda w: F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.get(F.transform(F.array(words(x)), lambda w: F.array_distinct(F.transform(at(w), lambda i: F.array_join(F.slice(w, i, n), " ")))), F.lit(0))

    a = grams(original)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, grams(rewritten))) / F.size(a)).otherwise(0.0)


def code_kept(original, rewritten) -> Column:
    """Whether every piece of code of the original, fenced or in backticks, stands in the rewritten text byte for byte; null without code."""
    spans = F.regexp_extract_all(F.coalesce(_c(original), F.lit("")), F.lit(r"(?s)```.*?```|`[^`\n]+`"), F.lit(0))
    return F.when(F.size(spans) > 0, F.forall(spans, lambda x: F.coalesce(_c(rewritten), F.lit("")).contains(x)))


def token_summary(df, turns: str = "turns"):
    """``docs, mean, median, p95, most, total`` of the estimated tokens of documents: a corpus' size before it is sent anywhere."""
    t = token_estimate(turns)
    q = lambda x: F.percentile("_t", F.lit(x))
    return df.select(t.alias("_t")).agg(F.count("_t").alias("docs"), F.avg("_t").alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), F.max("_t").alias("most"), F.sum("_t").alias("total"))


def parse_score(reply, field: str = "score") -> Column:
    """A judge's score from 1 to 5: the JSON field, else the last labelled number; else null."""
    json_ = F.get_json_object(strip_fence(reply), f"$.{field}")
    labelled = F.regexp_extract_all(F.coalesce(_c(reply), F.lit("")), F.lit(rf"(?i){field}\W{{0,5}}([0-9]+)"), F.lit(1))
    found = F.coalesce(F.expr("null").cast("string") if json_ is None else json_, F.get(F.reverse(labelled), F.lit(0)))
    value = found.try_cast("int")
    return F.when(value.between(1, 5), value)


def strip_fence(text) -> Column:
    return F.regexp_replace(_c(text), r"(?s)^\s*```(?:\w+)?\s*\n?(.*?)\n?```\s*$", "$1")


def parse_ranking(reply, k: int) -> Column:
    """Ranking of a judge as 0-based slots: numbers of the reply's list from 1 to k, repeats dropped."""
    body = F.regexp_extract(strip_fence(F.coalesce(_c(reply), F.lit(""))), r"\[([\d\s,]*)\]?", 1)
    nums = F.transform(F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.transform(F.filter(nums, lambda x: x.between(1, k)), lambda x: x - 1))


def parse_choice(reply) -> Column:
    """The last digit of a reply, else 0."""
    return F.coalesce(F.get(F.reverse(F.regexp_extract_all(F.coalesce(_c(reply), F.lit("")), F.lit("[0-9]"), F.lit(0))), F.lit(0)), F.lit("0")).cast("int")


def to_utc(text) -> Column:
    """Timestamps in the formats of chat exports, also ``ts:`` and seconds; null where none fits."""
    t = F.trim(_c(text))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    secs = F.regexp_extract(t, r"^ts:(\d+(?:\.\d+)?)$", 1).try_cast("double")
    return F.coalesce(*tries, F.timestamp_micros((secs * 1000000).cast("bigint")))
