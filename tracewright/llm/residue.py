"""Problem 4: turns that are leftovers of templates, filler, error pages or notices about scripts.

These data have no addresses. What an address promises of a page, the other turns of the conversation promise of a turn;
the first segment of a turn is its heading, the others are its body; a conversation's source is its host.

1. Placeholder detectors mark a turn by itself: delimiters of template languages around a variable's name or an
   instruction, blanks to be filled in.
2. A turn is cut into segments (lines, sentences, codes). Detectors mark segments that are filler, titles of error
   pages or notices; questions are never marked.
3. Terms are compared: a turn that shares no term with any other turn of its conversation is out of place, and one whose
   heading shares no term with its body is apart.
4. Evidence from the corpus: every segment, without its numbers and names, is a phrase. Of all turns that hold a phrase
   it is counted, for each host, how many had other segments marked (a quarter of
   the other words), how many were out of place and how many apart. The
   rates of a phrase (each host has the same say, so that a large one can't decide alone) are weighed against those of all
   turns, in bits. A phrase of two conversations or more whose bits together reach the threshold, or most of whose turns have another
   segment marked, is part of such pages, also where it stands alone: unrelated places repeat it, and it tells nothing
   about any of them.
5. A turn is a case if nearly all its words are in marked segments or in such phrases; by bits alone only if it
   isn't in place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from ._turns import QUOTED, without_code

_I = regex.I | regex.V0
# names and instructions that stand in placeholders
_name = r"[\p{L}_][\p{L}\p{N}_.\- ]{0,40}"
_PLACEHOLDERS = [
    regex.compile(rf"\{{\{{\s*[#/^&>]?\s*{_name}\s*(?:\|[^{{}}]{{0,30}})?\}}\}}"),
    regex.compile(rf"[$#]\{{\s*{_name}\s*\}}"),
    regex.compile(rf"<%[=-]?\s*{_name}\s*-?%>"),
    regex.compile(rf"\[\[\s*{_name}\s*\]\]"),
    regex.compile(rf"<<\s*{_name}\s*>>"),
    regex.compile(rf"@@\s*{_name}\s*@@"),
    regex.compile(rf"\*\|\s*{_name}\s*\|\*"),
    regex.compile(rf"(?<![\w%])%{_name}%(?![\w%])"),
    regex.compile(r"(?<![\w])__(?!(?:init|main|name|file|str|repr|call|len|iter|next|dict|doc|all|enter|exit|new|del|eq|hash|version|future)__)\p{L}[\p{L}\p{N}_ ]{0,40}?__(?!\w)"),
    regex.compile(r"(?<![\w\])])\[(?!(?:x|sic|at|dot|ed|\.\.\.|punkt|arroba)\])\p{L}[\p{L}\p{N}_ ,.'’/-]{0,80}\](?![(\[:\w])", regex.I),
    regex.compile(rf"(?<![\w{{}}$#(=:])\{{\s*[\p{{L}}_][\p{{L}}\p{{N}}_ ]{{0,40}}\s*\}}(?![\w{{}}])"),
    regex.compile(r"<(?!/|!|(?:a|b|i|u|p|h[1-6]|br|hr|li|ul|ol|td|tr|th|em|div|img|pre|sub|sup|code|span|html|head|body|meta|link|form|main|table|title|style|script|strong|button|noscript|iframe|input|label|nav|header|footer|section|article)\b)\p{L}[\p{L}\p{N}_ ]{0,40}>", regex.I),
    # instructions in round or square brackets, and blanks
    regex.compile(r"[\[(<]\s*(?:please\s+)?(?:insert|paste|enter|add|type|put|fill in|write|describe|replace|your|einfügen|hier|insérer|inserez|coller|inserir|insertar|inserte|pegar|escriba|inserisci|voeg|vul|вставьте|введите|请输入|在此)\b[^\[\]()<>\n]{2,100}\b(?:here|below|above|line|text|name|hier|ici|aquí|aqui|qui|сюда|здесь|此处)\b[^\[\]()<>\n]{0,40}[\])>]", regex.I),
    regex.compile(r"_{4,}|_{2,}\s*/\s*_{2,}\s*/\s*_{2,}|(?<!\.)\.{6,}(?!\.)"),
    regex.compile(r"(?:^|\n)\s*(?:TODO|TBD|FIXME|XXX)\b\s*:?[^\n?]{0,80}", 0),
]
_FILLER = regex.compile(
    r"\b(?:placeholder|dummy|sample|filler|example|test|blind|platzhalter|beispiel)[\s-]*(?:text|content|copy|paragraph|inhalt|texte|texto|testo|tekst)\b"
    r"|\blorem\s+ipsum\b|\bblindtext\b|\b(?:texto|contenido|texte|testo) (?:de|di) (?:ejemplo|relleno|exemple|remplissage|esempio|riempimento|exemplo)\b|\b(?:bla[ -]?){3,}|(?:占位|示例)文[本字]|текст[- ]заполнитель",
    _I,
)
#: Words of the usual Latin filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud"
    " exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur"
    " excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae porta massa nunc vestibulum pellentesque".split()
)
_ERROR_START = regex.compile(
    r"^\W*(?:(?:http|api|server|fatal|internal|runtime)\s+)?(?:error|erreur|fehler|errore|erro|fout|ошибка|错误)\W*(?:[45]\d\d\b|[:#]\s*\d{2,}|$)"
    r"|^\W*(?:[45]\d\d)\b\W*(?:$|not found|bad |internal|service|gateway|forbidden|unauthori[sz]ed|too many|request|error|page|seite|página|pagina|страница)"
    r"|^\W*(?:api error\b|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|access denied|forbidden$|not found$|too many requests|rate limit exceeded"
    r"|(?:page|file|site|resource)\s+not\s+found|seite nicht gefunden|zugriff verweigert|p[aá]gina (?:no encontrada|n[aã]o encontrada|non trovata)|page (?:non trouvée|introuvable)|acc[eè]s (?:refusé|interdit)|acceso denegado|acesso negado|accesso negato|pagina niet gevonden|toegang geweigerd|страница не найдена|доступ (?:запрещ[её]н|закрыт)|找不到(?:页面|该页)|页面不存在|拒绝访问|oops\b|whoops\b)"
    r"|^\W*\{\s*\"(?:error|errors|status|code|message|detail)\"\s*:",
    _I,
)
_ERROR_INSIDE = regex.compile(
    r"\b(?:something went wrong|an error (?:has )?occurred|etwas ist schief|une erreur (?:s'est produite|est survenue)|algo sali[oó] mal|ha ocurrido un error|ocorreu um erro|si è verificato un errore|er is iets misgegaan|произошла ошибка|出错了)\b"
    r"|\b(?:page|resource|link|url) (?:you (?:asked for|requested)|(?:no longer|does not) exists?)\b|\b(?:do not|don't) have (?:permission|access)\b.{0,20}\b(?:page|resource|site)"
    r"|\b(?:server|host|upstream|gateway)\b.{0,40}\b(?:could not|did not|gave no|failed|closed|refused|timed out)\b|\bconnection (?:was )?(?:closed|reset|refused|timed out)\b",
    _I,
)
_SCRIPTS = r"(?:java\s?script|scripts?|cookies?)"
_NOTICE = regex.compile(
    rf"\b(?:enable|activate|allow|turn on|accept|requires?|needs?|without|aktivieren|aktiviere|erlauben|einschalten|activer|activez|autorisez|active|activar|habilite|habilitar|ative|ativar|attiva|attivare|abilita|abilitare|schakel|inschakelen|включите|разрешите|启用|开启)\b.{{0,40}}{_SCRIPTS}"
    rf"|{_SCRIPTS}.{{0,40}}\b(?:is|are|must be|has to be|have to be|ist|sind|est|sont|está|están|estão|è|zijn|отключ\w*|выключ\w*)\b.{{0,20}}(?:disabled|enabled|blocked|required|needed|turned off|deaktiviert|blockiert|erforderlich|benötigt|désactivé|bloqué|requis|nécessaire|desactivad|bloquead|necesari|desativad|necessári|disabilitat|disattivat|bloccat|uitgeschakeld|vereist|nodig)"
    rf"|\b{_SCRIPTS} (?:required|disabled|blocked|erforderlich|requis\w*|requerid\w*|necessári\w*|richiest\w*|vereist)|\bscripts? (?:are|is) blocked"
    r"|\b(?:checking|verify|verifying|could not verify|überprüf\w*|vérifi\w*|verific\w*)\b.{0,20}\b(?:your|the|ihr\w*|votre|su|seu|il tuo|je) (?:browser|navigateur|navegador|connection)|checking,? please wait|please wait while|(?:will|does) not (?:work|load|run) without (?:it|them)\b|just a moment\.\.\.|<noscript"
    r"|启用.{0,6}(?:脚本|cookie)|включите.{0,12}(?:скрипт|javascript)",
    _I,
)
#: One of these stands in every text that a pattern above can match inside; looked for once in a turn.
_ERROR_HINTS = (
    "wrong", "occurred", "schief", "erreur", "algo", "ocurrido", "ocorreu", "verificato", "misgegaan", "произошла", "出错", "you asked for", "you requested", "no longer", "does not exist", "have permission", "have access", "server", "host", "upstream",
    "gateway", "connection",
)
_NOTICE_HINTS = ("script", "cookie", "browser", "navigateur", "navegador", "connection", "please wait", "without", "just a moment", "脚本", "скрипт")
_FILLER_HINTS = ("text", "content", "copy", "paragraph", "inhalt", "testo", "tekst", "lorem", "contenido", "bla", "占位", "示例", "текст")
_ASKS = regex.compile(
    r"[?？]\s*$|^\W*(?:how|why|what|who|when|where|which|is|are|do|does|can|could|should|would|wie|warum|was|wer|wieso|weshalb|comment|pourquoi|qu[e']|qui|cómo|como|por qu|qué|quién|perch|come|cosa|chi|hoe|waarom|wat|wie|как|почему|что|кто|怎么|为什么|什么)\b",
    _I,
)
_CODE = regex.compile(r"^\W*(?:(?:reference|ref|ray(?: id)?|code|error|request id|id|incident)\W*[#:]?\W*[\dA-Fa-f-]{3,}|\d{3,})\W*$", _I)
_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_CUT = regex.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+|\s+[|·»]\s+|\s+[-–—]\s+|</?[a-zA-Z][^<>]{0,200}>|(?<=\S)\s*(?=\((?:ray|code|ref|reference|error|id)\b)", regex.I)
_WORD = regex.compile(r"\p{Han}|[\p{L}\p{N}'’]+")
_NUM = regex.compile(r"\d+")
_NAMES = regex.compile(r"(?<=\S\s)\p{Lu}[\p{Ll}\p{M}]+")


def placeholder(text: str) -> bool:
    """Whether a turn has an unfilled placeholder outside code, quotes and markers."""
    body = QUOTED.sub(lambda m: " " * len(m.group()), without_code(text))
    return any(rx.search(body) for rx in _PLACEHOLDERS)


def _filler(segment: str, words: list[str], named: bool = True) -> bool:
    if len(words) >= 4 and sum(w in LOREM for w in words) >= 0.6 * len(words):
        return True
    if len(words) >= 3 and len(set(words)) <= max(1, len(words) // 4):
        return True
    if len(words) >= 3 and all(len(set(w)) == 1 and not w.isdigit() for w in words) and sum(map(len, words)) >= 2 * len(words):
        return True  # xxxx xxx xx
    return named and len(words) <= 14 and bool(_FILLER.search(segment))


def _marks(text: str, patterns: bool = True) -> list[tuple[str, int, int, list[str]]]:
    """Skeleton, number of words, mark and words of each segment of a turn."""
    body = without_code(text)
    low = body.lower()
    notice = patterns and "<noscript" in low
    inside, notices, fillers = (patterns and any(h in low for h in hints) for hints in (_ERROR_HINTS, _NOTICE_HINTS, _FILLER_HINTS))
    out = []
    for part in _CUT.split(body):
        part = (part or "").strip()
        words = [w.lower() for w in _WORD.findall(part)]
        if not words:
            continue
        skeleton = _NAMES.sub("#", part)
        skeleton = " ".join(_WORD.findall(_NUM.sub("0", skeleton.lower())))
        error = patterns and (_ERROR_START.match(part) or inside and _ERROR_INSIDE.search(part))
        if not error and (_CODE.match(part) or part.startswith(("{", '"')) and len(words) <= 3):
            mark = 2
        elif _ASKS.search(part):
            mark = 0
        elif patterns and (notice or error or _filler(part, words, fillers) or notices and _NOTICE.search(part)):
            mark = 1
        else:
            mark = 2 if len(words) <= 2 and not part.endswith((".", "!")) else 0
        out.append((skeleton, len(words), mark, words))
    return out


def segments(text: str) -> list[tuple[str, int, int]]:
    """Skeleton, number of words and mark of each segment of a turn.

    Marks: 0 nothing, 1 detected, 2 neutral (codes, names of one or two words).
    """
    return [m[:3] for m in _marks(text)]


def terms(words: list[str]) -> set[str]:
    """Words of four letters or more, and pairs of neighbouring Han characters."""
    return {w for w in words if len(w) > 3} | {a + b for a, b in zip(words, words[1:]) if len(a) == len(b) == 1 and a > "\u2e7f" < b}


_SCHEMA = "doc_id string, host string, turn_no int, seg bigint, words int, mark int, others boolean, strange int, apart int, holder boolean"


def _rows(patterns: bool):
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for doc, host, turns in zip(*(b.column(i).to_pylist() for i in range(3))):
                there = [(no, t) for no, t in enumerate(turns) if t and not t.isspace()]
                marks = [_marks(t, patterns) for _, t in there]
                own = [[terms(m[3]) for m in ms] for ms in marks]
                # how many turns of the conversation hold a term
                held = Counter(w for ts in own for w in set().union(*ts))
                for (no, text), ms, ts in zip(there, marks, own):
                    all_terms = set().union(*ts)
                    # 1 without a term in common, 0 with one, null where nothing can be compared
                    around = len(held) > len(all_terms) or any(held[w] > 1 for w in all_terms)
                    strange = int(all(held[w] == 1 for w in all_terms)) if all_terms and around else None
                    body = set().union(*ts[1:]) if len(ts) > 1 else set()
                    apart = int(ts[0].isdisjoint(body)) if body and ts[0] else None
                    holder = patterns and placeholder(text)
                    marked = sum(m[1] for m in ms if m[2] == 1)
                    size = sum(m[1] for m in ms if m[2] != 2)
                    # equal segments of a turn go together
                    merged: dict[tuple[str, int], int] = Counter()
                    for s, w, m, _ in ms:
                        merged[s, m] += w
                    merged = merged or {("", 2): 0}
                    for (s, m), w in merged.items():
                        # whether a quarter of the turn's other words are in marked segments
                        beside = marked - w * (m == 1) > 0 and 4 * (marked - w * (m == 1)) >= size - w * (m != 2)
                        row = (doc, host, no, xxhash.xxh3_64_intdigest(s) - (1 << 63), w, m, beside, strange, apart, holder)
                        for c, v in zip(cols, row):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _rates(each: DataFrame, *keys: str) -> DataFrame:
    """Turns, those that can be compared, and those with each kind of evidence, by the keys."""
    parts = {"turns": F.lit(1), "beside": F.col("others").cast("int"), "placed": F.col("strange").isNotNull().cast("int"), "strange": F.col("strange"), "headed": F.col("apart").isNotNull().cast("int"), "apart": F.col("apart")}
    return each.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in parts.items()])


def page_phrases(rows: DataFrame, least_conversations: int = 2, bits: float = 5.5, drawn: int = 3) -> DataFrame:
    """``seg, weight, most``: phrases that the evidence of all their turns shows to be parts of such pages, their bits, and
    whether they stand beside marked segments in most of their turns.

    The counts are exact, over all turns, and aggregated in steps (conversation, host, phrase) before the phrases meet the
    three rates of the whole corpus, one row.
    """
    phrases = rows.where("mark = 0 and words > 2")
    # phrases of no turn with evidence can't be learned
    hint = phrases.where("others or strange = 1").select("seg").distinct()
    some = phrases.join(hint, "seg", "left_semi")
    by_doc = _rates(some, "seg", "host", "doc_id")
    sums = [F.sum(c).alias(c) for c in ("turns", "beside", "placed", "strange", "headed", "apart")]
    by_host = by_doc.groupBy("seg", "host").agg(F.count(F.lit(1)).alias("docs"), *sums)
    per_turn = rows.groupBy("doc_id", "turn_no").agg(F.max("others").alias("others"), F.max("strange").alias("strange"), F.max("apart").alias("apart"))
    whole = _rates(per_turn).select(*[((F.col(k) + 1) / (F.col(n) + 2)).alias(f"all_{k}") for k, n in _EVIDENCE])
    # hosts have equal say: rates are means over them; a rate of few turns is drawn to the corpus' as by ``drawn`` more
    means = [F.avg(F.when(F.col(n) > 0, F.col(k) / F.col(n))).alias(f"mean_{k}") for k, n in _EVIDENCE]
    seen = [F.sum(n).alias(f"n_{k}") for k, n in _EVIDENCE] + [F.sum("beside").alias("beside_turns")]
    stat = by_host.groupBy("seg").agg(F.sum("docs").alias("docs"), *means, *seen).where(F.col("docs") >= least_conversations)
    stat = stat.crossJoin(F.broadcast(whole))  # a single row
    weight = F.lit(0.0)
    for k, _ in _EVIDENCE:
        n, mean, base = F.col(f"n_{k}"), F.coalesce(F.col(f"mean_{k}"), F.lit(0.0)), F.col(f"all_{k}")
        gain = F.log2((mean * n + drawn * base) / (n + drawn) / base)
        weight = weight + (F.greatest(gain, F.lit(0.0)) if k == "beside" else gain)  # to stand alone speaks for nothing
    most = F.coalesce(F.col("beside_turns") >= 0.5 * F.col("n_beside"), F.lit(False))
    return stat.withColumn("weight", weight).where(most | (F.col("weight") >= bits)).select("seg", "weight", most.alias("most"))


#: Kinds of evidence: turns that show it, turns that could.
_EVIDENCE = (("beside", "turns"), ("strange", "placed"), ("apart", "headed"))


def residue_turns(
    df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", source_col: str = "source", least_conversations: int = 2, bits: float = 5.5, patterns: bool = True
) -> DataFrame:
    """``doc_id, turn_no, kind``: the turns that are no words of a user; kind is ``placeholder`` or ``page``.

    Null, empty and blank turns are no cases, nor are rows with a null id; a repeated delivery counts once; other columns
    are left out; an empty table gives an empty one. Turns are read whole, whatever their length; a missing or null source is
    a host of its own. Without ``patterns`` no detector is used and the evidence of the corpus decides alone.
    """
    host = F.col(source_col).cast("string") if source_col in df.columns else F.lit(None).cast("string")
    turns = df.where(F.col(id_col).isNotNull() & F.col(turns_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(host, F.lit("")).alias("host"), F.col(turns_col).alias("turns"))
    # written once, as all segments of all turns are read three times
    rows = cut(spread(turns, "doc_id").dropDuplicates(["doc_id", "turns"]).mapInArrow(_rows(patterns), _SCHEMA))
    judged = rows.join(page_phrases(rows, least_conversations, bits), "seg", "left")
    part = F.col("weight").isNotNull() & (F.col("mark") == 0)
    bad = (F.col("mark") == 1) | part
    weigh = F.when(F.col("mark") == 2, 0).otherwise(F.col("words"))
    verdict = judged.groupBy("doc_id", "turn_no").agg(
        F.sum(F.when(bad, weigh).otherwise(0)).alias("bad"), F.sum(weigh).alias("all"), F.max("holder").alias("holder"), F.max(bad).alias("any"),
        F.max((F.col("mark") == 1) | (part & F.col("most"))).alias("marked"), F.max(F.coalesce("strange", F.lit(1)) == 1).alias("strange"),
    )
    page = F.col("any") & (F.col("bad") >= 0.75 * F.col("all")) & (F.coalesce("marked", F.lit(False)) | F.col("strange"))
    return verdict.where(F.col("holder") | page).select("doc_id", "turn_no", F.when(F.col("holder"), "placeholder").otherwise("page").alias("kind"))


def found_turns(df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns") -> DataFrame:
    """``doc_id, turn_no`` of the cases."""
    return residue_turns(df, id_col, turns_col).select("doc_id", "turn_no")
