"""Problem 2: personal information in free text, found and replaced by typed placeholders.

Information-theoretic sanitisation. Patterns only propose; what the corpus shows decides, for every kind, by disclosure in
bits: how much more often a term goes with protected entities than any term does.

* Names and towns: every term (given name, surname, town) is weighed by the share of its occurrences that stand in a slot
  which a strong cue (a title, an introduction, a full address) opens, against the share of any term. A term whose
  disclosure exceeds the threshold and which was seen in two turns or more identifies also where no cue stands: in
  capitals anywhere, in lower case after a cue or on a line of its own. A cue with terms that disclose nothing is dropped.
* Emails, numbers and addresses: every slot of the corpus that holds a long number or a proposed item counts for the word
  before it. An item's disclosure is the log ratio of its kind's share of the slots after that word and its share of all
  slots, and the mean of that over all items of its shape. Items whose words open slots of other things (orders, books,
  machines) fall below the threshold and stay; a cue that names the kind itself adds its own bits.

All measures are shares, rates and bits, so that they mean the same at every size. The statistics cover all turns. Terms
meet their candidates in joins, so that no list of names is ever broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread
from ._turns import explode_turns, without_code

KINDS = ("email", "phone", "id_number", "street_address", "person_name")
_I = regex.I

# --- items that patterns decide -----------------------------------------------------------------------------------------
_label = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
_EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+\-@])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._%+\-]*[\p{{L}}\p{{N}}_])?"
    rf"(?:\s?[@＠]\s?{_label}(?:\.{_label})*\.\p{{L}}{{2,}}"
    rf"|\s?[\[({{]\s?(?:at|arroba|chez|ät)\s?[\])}}]\s?{_label}(?:\s?(?:[\[({{]\s?(?:dot|punkt|point|punto|ponto)\s?[\])}}]|\.)\s?{_label})*\s?(?:[\[({{]\s?(?:dot|punkt|point|punto|ponto)\s?[\])}}]|\.)\s?\p{{L}}{{2,}}"
    rf"|\s(?:AT|at)\s{_label}(?:\s(?:DOT|dot)\s{_label})*\s(?:DOT|dot)\s\p{{L}}{{2,}})(?![\p{{L}}\p{{N}}@])"
)
_no = r"(?<![\p{L}\p{N}_.,@#$€£/\-])"
_end = r"(?![\p{L}\p{N}_@]|[.,\-/]\d)"
_ID = [
    regex.compile(_no + p + _end, _I)
    for p in (
        r"\d{3}([ \-])\d{2}\1\d{4}",
        r"\d{6}[\-+]\d{4}",
        r"\d{2} \d{3} \d{3} \d{3}",
        r"\d{8}\s?-\s?[a-z]",
        r"(?-i:\d{8}[A-Z])",
        r"[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]",
        r"[a-z]{2}\d{2}[a-z]\d{6}",
        r"(?-i:[A-Z]\d{8})",
        r"[xyz]-?\d{7}-?[a-z]",
        r"(?-i:[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])",
        r"\d{3}\.\d{3}\.\d{3}-\d{2}",
    )
]
_ID_CUE = regex.compile(
    r"(?:passport|passeport|pasaporte|passaporte|passaporto|paspoort|reisepass|ausweis\w*|personalausweis|driv(?:er|ing)(?:'s)? licen[cs]e|permis de conduire|führerschein\w*|rijbewijs|patente"
    r"|tax(?:payer)? (?:id|no|number)\w*|steuer[ \-]?(?:id|nummer|nr)\w*|num[eé]ro fiscal|n[uú]mero fiscal|codice fiscale|nif|nie|dni|cpf|bsn|ssn|social security(?: number)?|sozialversicherungsnummer|national (?:id|identity|insurance)(?: number| no)?|identity (?:card|number)|id(?:entification)? number)"
    r"(?:\s?(?:no|nr|n°|number|nummer|num[eé]ro|card)\b\.?)?\s?(?:[:,#]|is|ist|est|es|è|é|which is|lautet)*\s?(?:is\s)?",
    _I,
)
_ID_ANY = regex.compile(r"(?=(?:[\p{L} .\-/]*\d){5})[\p{L}]{0,3}\d[\p{L}\d]*(?:[ .\-/][\p{L}]?\d[\p{L}\d]*){0,4}(?:[ \-]\p{L}\b)?", _I)
_PHONE = [
    regex.compile(r"(?<![\p{L}\p{N}_.,@#/\-+])" + p + r"(?![\p{L}\p{N}_@]|[.,\-/]\d)")
    for p in (
        r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(\d{1,4}\))?(?:[ .\-/]?\d){6,12}",
        r"(?:1[ .\-])?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}",
        r"(?:1[ .\-])?\d{3}([.\-])\d{3}\1\d{4}",
        r"0\d(?:[ .\-]\d{2}){4}",
        r"\(?0\d{2,5}\)?[ .\-/]?\d{3,4}[ .\-]?\d{3,4}",
        r"0\d{9,10}",
    )
]
_digit = r"(?:zero|oh|null|one|two|three|four|five|six|seven|eight|nine)"
_SPOKEN = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:plus\s)?{_digit}(?:[\s\-]{_digit}){{7,14}}(?![\p{{L}}\p{{N}}])", _I)

# --- addresses ----------------------------------------------------------------------------------------------------------
_n = r"[\p{L}][\p{L}'’\-]+"
_flat = r"(?:(?:flat|apt\.?|apartment|unit|suite|room)\s\d{1,4}\s?\p{L}?,\s)?"
_types = r"(?:street|st\.?|road|rd\.?|lane|ln\.?|avenue|ave\.?|drive|dr\.?|close|crescent|court|ct\.?|place|square|terrace|boulevard|blvd\.?|way|grove|gardens|mews|parade|hill|row)"
_EN = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}.\-]){_flat}\d{{1,4}}\s?[a-zA-Z]?,?\s(?P<name>{_n}(?:\s{_n}){{0,3}}?)\s(?P<type>{_types})(?![\p{{L}}\p{{N}}])(?:,?\s(?:flat|apt\.?|apartment|unit|suite)\s\d{{1,4}}\s?\p{{L}}?)?", _I
)
_DE = regex.compile(
    r"(?<![\p{L}\p{N}\-])(?:\p{Lu}[\p{L}\-]+\s){0,3}\p{Lu}?[\p{L}\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|ring|steig|markt)\s\d{1,4}\s?[a-z]?(?![\p{L}\p{N}])|"
    r"(?<![\p{L}\p{N}\-])\p{Lu}[\p{L}\-]*(?:straat|laan|plein|gracht|kade|singel|dijk)\s\d{1,4}\s?[a-z]?(?![\p{L}\p{N}])",
    _I,
)
_FR = regex.compile(
    r"(?<![\p{L}\p{N}.\-])\d{1,4}(?:\s(?:bis|ter|quater))?,?\s(?:rue|avenue|av\.|boulevard|bd\.?|place|chemin|impasse|allée|allee|quai|cours|route|square|passage)\s(?:(?:de la|de l'|du|des|de|d'|de l’|d’)\s?)?[\p{L}][\p{L}'’\-]*(?:\s\p{Lu}[\p{L}'’\-]*){0,3}",
    _I,
)
_ES = regex.compile(
    r"(?<![\p{L}\p{N}\-])(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carretera|ronda|travesía|rua|praça|praca|travessa|estrada|via|viale|piazza|corso|largo)\s(?:(?:de la|de las|de los|del|de|da|do|dos|das|della|dei|di)\s)?"
    r"[\p{L}][\p{L}'’\-]*(?:\s[\p{L}][\p{L}'’\-]*){0,3}?,?\s(?:n\.?º\s?)?\d{1,4}(?![\p{L}\p{N}])(?:,\s\d{1,2}\s?\.?\s?[ºª°](?:\s?\p{L}\b)?)?",
    _I,
)
_POST = r"(?:\d{5}(?:-\d{3,4})?|\d{4}\s?[A-Z]{2}|[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})"
_TOWN = regex.compile(rf"(?:,\s{{1,2}}|\s?\n\s?)(?P<post>{_POST}\s)?(?P<town>{_n}(?![\p{{L}}\p{{N}}])(?: {_n}(?![\p{{L}}\p{{N}}])){{0,2}})", _I)
_POST_AFTER = regex.compile(rf",?\s{_POST}(?![\p{{L}}\p{{N}}])", _I)
_ADDRESS_CUE = regex.compile(
    r"(?:live at|lives at|living at|ship(?: it)? to|send(?: it)? to|deliver(?: it)? to|moved to|address(?: is)?|located at|adresse(?: lautet)?|anschrift|wohne \S*|genau hier|habite(?: au)?|livraison|vivo en|direcci[oó]n|domicilio|env[ií]a\w*|indirizzo|abito in|moro na|endere[cç]o|put)\s?:?\s*$",
    _I,
)

# --- names --------------------------------------------------------------------------------------------------------------
_cap = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*"
_any = r"[\p{L}][\p{L}'’]+(?:-[\p{L}][\p{L}'’]+)*"
_part = r"(?:\s(?:van|von|de|der|den|di|da|do|dos|del|della|la|le|du|el|al|bin|ter|ten|zu|af|av|VAN|VON|DE|DER|DEN|DI|DA|DEL|LA|DU)){0,2}"
_TITLE = r"(?:mr|mrs|ms|mx|dr|prof|herr|herrn|frau|mme|mlle|m|monsieur|madame|se[ñn]or|se[ñn]ora|sr|sra|srta|signor|signora|sig|sig\.ra|dott|senhor|senhora|dona|don|meneer|mevrouw|dhr|mevr|г-н|г-жа|господин|госпожа)\b\.?"
_INTRO = (
    r"\b(?:i am|i'm|my name is|this is|call me|name:|ich hei(?:ß|ss)e|ich bin|mein name ist|je m['’]appelle|je suis|mon nom est|me llamo|soy|mi nombre es|mi chiamo|sono|il mio nome è|chamo-me|me chamo|meu nome é|ik heet|mijn naam is|меня зовут"
    r"|sign (?:it )?as|signed(?: by)?:?|patient(?:in)?:|client:|customer:|contact:|attn:?|according to|(?:my )?neighbou?r|(?:my )?colleague|dear|(?:kind |best |warm )?regards,?|sincerely,?|cheers,?|(?:viele |liebe |freundliche )?grüße,?|cordialement,?|saludos,?|atentamente,?)"
)
_CUE = regex.compile(rf"(?:(?<![\p{{L}}]){_TITLE}|{_INTRO})[ \t]*\n?\s?", _I)
_FORM_CAP = regex.compile(rf"(?P<a>{_cap}|\p{{Lu}}\.)(?P<comma>,)?(?:\s\p{{Lu}}\.)?{_part}\s(?P<b>{_cap})(?!['’\-]?\p{{L}})")
_FORM_ANY = regex.compile(rf"(?P<a>{_any}|\p{{L}}\.)(?P<comma>,)?(?:\s\p{{L}}\.)?{_part}\s(?P<b>{_any})(?!['’\-]?\p{{L}})", _I)
_WORD = regex.compile(r"[\p{L}][\p{L}'’]+")
# a word and what may stand between it and a number
_BEFORE = regex.compile(r"([\p{L}][\p{L}'’\-]*)[^\p{L}\p{N}\n]{0,6}$")
_NUMBER = regex.compile(r"(?<![\p{L}\p{N}])\d(?:[ .\-/]?\d){4,}")
# what must be there before the costlier patterns are tried
_AT = regex.compile(r"[@＠]|[\[({]\s?(?:at|arroba|chez|ät)\s?[\])}]|\s(?:DOT|dot)\s")
_DE_HINT = regex.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|damm|ufer|ring|steig|markt|straat|laan|plein|gracht|kade|singel|dijk)\s\d", _I)
_DIGIT = regex.compile(r"\d")
_WIDE = str.maketrans("０１２３４５６７８９＋（）－．", "0123456789+().-")


_OTHER = regex.compile(r"(?:tel\w*|phone|call|ring)\W{0,3}(?:no|number|nr)?\W{0,4}$")


def _free(spans: list[tuple], start: int, end: int) -> bool:
    return all(end <= x[1] or start >= x[2] for x in spans)


def structured(text: str) -> list[tuple[str, int, int, str, int]]:
    """Emails, numbers of identity and phones of a turn: kind, start, end, shape, strength of the cue."""
    spans: list[tuple] = []
    if _AT.search(text):
        for m in _EMAIL.finditer(text):
            spans.append(("email", m.start(), m.end(), "email", 0))
    plain = text.translate(_WIDE)  # one character for one
    digits = bool(_DIGIT.search(plain))
    if digits:
        for m in _ID_CUE.finditer(plain):
            if (v := _ID_ANY.match(plain, m.end())) and _free(spans, v.start(), v.end()):
                spans.append(("id_number", v.start(), v.end(), "cue", 3))
        for i, rx in enumerate(_ID):
            for m in rx.finditer(plain):
                before = plain[max(0, m.start() - 24) : m.start()].lower()
                if _free(spans, m.start(), m.end()) and not _OTHER.search(before):
                    spans.append(("id_number", m.start(), m.end(), f"id{i}", 0))
    for m in _SPOKEN.finditer(plain):
        spans.append(("phone", m.start(), m.end(), "spoken", 0))
    if digits:
        for i, rx in enumerate(_PHONE):
            for m in rx.finditer(plain):
                if 8 <= sum(map(str.isdigit, m.group())) <= 15 and _free(spans, m.start(), m.end()):
                    spans.append(("phone", m.start(), m.end(), f"phone{i}", 0))
    return spans


def before(text: str, start: int) -> str:
    """The word before a place in a text, in lower case; empty where a line or the text begins."""
    m = _BEFORE.search(text, max(0, start - 32), start)
    return m.group(1).lower() if m else ""


def addresses(text: str, taken: list[tuple]) -> list[dict]:
    """Addresses of a turn, each with its possible ends: the street alone, or with one to three words of a town."""
    out = []
    if not _DIGIT.search(text):
        return out
    for rx in (_EN, _FR, _ES, *([_DE] if _DE_HINT.search(text) else [])):
        for m in rx.finditer(text):
            start, end = m.start(), m.end()
            if not _free(taken, start, end) or any(not (end <= a["start"] or start >= a["reach"]) for a in out):
                continue
            if rx is _DE:  # the names before the kind of street begin with capitals, the sentence's words don't belong to it
                head = regex.search(r"(?:\p{Lu}[\p{L}\-]+\s){0,3}\S+\s\d{1,4}\s?[a-z]?$", m.group())
                start = m.start() + (head.start() if head else 0)
            cased = text[start:end] != text[start:end].lower()
            if rx is _EN:
                names = m.group("name").split()
                named = all(w[:1].isupper() for w in names) and m.group("type")[:1].isupper()
                if not named and (cased and not text[start:end].isupper()):
                    continue
            else:
                named = cased
            cue = bool(_ADDRESS_CUE.search(text[max(0, start - 40) : start]))
            ends = [(end, "")]
            exact = False
            t = _TOWN.match(text, end)
            if t:
                words = [(w.group(), w.end()) for w in regex.finditer(_n, text[t.start("town") : t.end("town")])]
                broken = "\n" in text[end : t.start("town")]
                kept = []
                for w, e in words:
                    if named and not w[:1].isupper():
                        break
                    kept.append((w, t.start("town") + e))
                after = _POST_AFTER.match(text, kept[-1][1]) if kept else None
                if named and kept and (after or t.group("post")):
                    # a post code shows where the town is; its end is sure where no capital follows
                    follows = text[kept[-1][1] : kept[-1][1] + 2].strip()
                    exact = bool(after) or not follows[:1].isupper() and len(kept) < 3
                if not broken or after or t.group("post"):
                    for i, (_, e) in enumerate(kept):
                        phrase = " ".join(w for w, _ in kept[: i + 1]).lower()
                        tail = _POST_AFTER.match(text, e)
                        ends.append((tail.end() if tail else e, phrase))
                        if tail:
                            exact = exact or named
                            break
                if named and len(ends) > 1 and not exact:
                    nxt = text[ends[-1][0] : ends[-1][0] + 2]
                    exact = len(ends) == 2 and (not nxt.strip() or not nxt.strip()[0].isupper()) or bool(regex.match(r"[.,;!?\n)]|$", nxt)) and len(ends) <= 3
            out.append({"start": start, "reach": ends[-1][0], "ends": ends, "named": named, "cue": cue, "exact": exact})
    return out


def names(text: str, taken: list[tuple]) -> list[tuple[int, int, str, str, int]]:
    """Candidates for names: start, end, given name, surname (last part, lower case; "" an initial), strength of the cue."""
    out: dict[tuple[int, int], tuple] = {}

    def add(m, cue: int) -> None:
        if not _free(taken, m.start(), m.end()) or "\n" in m.group():
            return
        a, b = m.group("a"), m.group("b")
        given, sur = (b, a) if m.group("comma") else (a, b)
        g = "" if len(given) == 2 and given.endswith(".") else given.split("-")[0].lower()
        s = sur.split("-")[-1].lower()
        key = (m.start(), m.end())
        if key not in out or out[key][4] < cue:
            out[key] = (*key, g, s, cue)

    for c in _CUE.finditer(text):
        title = bool(regex.match(_TITLE, c.group(), _I))
        if m := _FORM_CAP.match(text, c.end()):
            add(m, 3 if title else 2)
        elif m := _FORM_ANY.match(text, c.end()):
            add(m, 1)
    for m in _FORM_CAP.finditer(text, overlapped=True):
        if m.start() and text[m.start() - 1].isalnum():
            continue
        add(m, 0)
    # a line of its own, whatever its case
    for line in regex.finditer(r"(?m)^[ \t]*(.{3,60}?)[ \t]*$", text):
        if m := _FORM_ANY.fullmatch(text, line.start(1), line.end(1)):
            add(m, 0)
    return list(out.values())


_SCHEMA = "doc_id string, turn_no int, kind string, start int, stop int, found string, given string, sur string, cue int, place int"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split()[0] for f in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    for b in batches:
        cols: list[list] = [[] for _ in fields]
        count: Counter = Counter()
        numbers: Counter = Counter()

        def put(*row) -> None:
            for c, v in zip(cols, row):
                c.append(v)

        for doc, no, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            body = without_code(text)
            spans = structured(body)
            for kind, s, e, shape, cue in spans:
                put(doc, no, kind, s, e, text[s:e], before(body, s), shape, cue, 0)
            taken = list(spans)
            for k, a in enumerate(addresses(body, spans)):
                strength = 3 if a["exact"] else 2 if a["named"] else 1 if a["cue"] else 0
                word = before(body, a["start"])
                for e, town in a["ends"]:
                    put(doc, no, "street_address", a["start"], e, text[a["start"] : e], town, word, strength, k)
                taken.append(("street_address", a["start"], a["reach"]))
            for m in _NUMBER.finditer(body):
                if _free(taken, m.start(), m.end()):
                    numbers[before(body, m.start())] += 1
            masked = list(body)
            for _, s, e, *_ in spans:
                masked[s:e] = " " * (e - s)
            rest = "".join(masked)
            for s, e, given, sur, cue in names(rest, taken):
                put(doc, no, "person_name", s, e, text[s:e], given, sur, cue, 0)
            count.update({w.lower() for w in _WORD.findall(rest)})
            count[""] += 1  # the turn itself
        for w, n in count.items():  # in how many turns a term occurs
            put(None, n, "term", 0, 0, None, w, None, 0, 0)
        for w, n in numbers.items():  # how many numbers that are no items follow a word
            put(None, n, "number", 0, 0, None, w, None, 0, 0)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], fields)


def slot_bits(items: DataFrame, numbers: DataFrame) -> DataFrame:
    """``kind, word, shape, bits`` of the emails, numbers and addresses: what the word before and the shape disclose.

    ``items`` has a row for each item (``kind, word, shape``), ``numbers`` the other numbers after a word (``word, n``).
    Aggregated before anything is joined; kinds are a table of four rows, shapes one of about thirty.
    """
    n = items.groupBy("kind", "word", "shape").agg(F.count(F.lit(1)).alias("c"))
    by_word = n.groupBy("kind", "word").agg(F.sum("c").alias("here"))
    slots = by_word.select("word", F.col("here").alias("n")).unionByName(numbers).groupBy("word").agg(F.sum("n").alias("slots"))
    whole = slots.agg(F.sum("slots").alias("all"))
    kinds = by_word.groupBy("kind").agg(F.sum("here").alias("of_kind")).crossJoin(F.broadcast(whole))  # a single row
    base = F.col("of_kind") / F.col("all")
    # no item vouches for itself; the share of a word with few slots is drawn to that of all slots, as by one more slot
    word_bits = F.log2((F.col("here") - 1 + base) / F.col("slots") / base)
    words = by_word.join(slots, "word").join(F.broadcast(kinds), "kind").select("kind", "word", F.when(F.col("word") == "", 0.0).otherwise(word_bits).alias("word_bits"))
    each = n.join(words, ["kind", "word"])
    shapes = each.groupBy("kind", "shape").agg((F.sum(F.col("c") * F.col("word_bits")) / (F.sum("c") + 10)).alias("shape_bits"))  # a rare shape says little
    return each.join(F.broadcast(shapes), ["kind", "shape"]).select("kind", "word", "shape", (F.col("word_bits") + F.col("shape_bits")).alias("bits"))


def personal_spans(
    df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns", bits: float = 4.0, share: float = 0.15, least: int = 2, against: float = 2.5, rare_bits: float = 12.0
) -> DataFrame:
    """``doc_id, turn_no, kind, start, stop, found``: items of personal information, with their place in the turn.

    ``bits`` is the disclosure beyond which a name or town identifies, ``share`` the least part of its occurrences in
    slots, ``least`` the least number of turns, without which there is no rate. Emails, numbers and addresses fall where
    word and shape speak against them by more than ``against`` bits. A surname counts as hardly known where other turns
    that hold it carry ``rare_bits`` of information or more. Null, empty and blank turns and null ids have none; a
    repeated delivery counts once; other columns are left out; an empty table gives an empty one. Turns are read whole.
    """
    turns = explode_turns(df, id_col, turns_col)
    raw = cut(spread(turns, "doc_id").mapInArrow(_candidates, _SCHEMA))
    items = raw.where("kind not in ('term', 'number')").distinct()
    total = raw.where("kind = 'term' and given <> ''").groupBy(F.col("given").alias("term")).agg(F.sum("turn_no").alias("n"))
    person = items.where("kind = 'person_name'")
    slots = person.where("cue >= 2 and sur <> ''").select(F.explode(F.array(F.struct(F.lit("g").alias("role"), F.col("given").alias("term")), F.struct(F.lit("s").alias("role"), F.col("sur").alias("term")))).alias("t"))
    slots = slots.select("t.*").where("term <> ''").groupBy("role", "term").agg(F.count(F.lit(1)).alias("slot"))
    whole = total.agg(F.sum("n").alias("all"))
    filled = slots.groupBy("role").agg(F.sum("slot").alias("slots"))
    weighed = slots.join(total, "term").join(F.broadcast(filled), "role").crossJoin(F.broadcast(whole))  # two rows, one row
    disclosed = F.log2((F.col("slot") / F.col("n")) / (F.col("slots") / F.col("all")))
    weighed = weighed.where((F.col("slot") >= share * F.col("n")) & (disclosed >= bits))
    role = lambda r, name: weighed.where(F.col("role") == r).select(F.col("term").alias(name), F.col("slot").alias(f"{name}_slot"))
    n_turns = raw.where("kind = 'term' and given = ''").agg(F.sum("turn_no").alias("turns"))
    also = total.crossJoin(F.broadcast(n_turns)).where((F.col("n") - 1) * 2.0**rare_bits > F.col("turns")).select(F.col("term").alias("sur"), F.lit(1).alias("usual"))
    judged = person.join(role("g", "given"), "given", "left").join(role("s", "sur"), "sur", "left").join(also, "sur", "left")
    is_given, is_sur = F.coalesce(F.col("given_slot") >= least, F.lit(False)), F.coalesce(F.col("sur_slot") >= least, F.lit(False))
    g = is_given | (F.col("given") == "")
    rare = F.col("given_slot").isNotNull()  # a term that stands in slots, if only in this one, behind a title
    sure = ((F.col("cue") >= 1) & is_given & F.col("usual").isNull()) | (g & is_sur & ((F.col("given") != "") | (F.col("cue") >= 1))) | ((F.col("cue") >= 2) & (g | is_sur)) | ((F.col("cue") == 3) & rare)
    people = judged.where(sure).select("doc_id", "turn_no", "kind", "start", "stop", "found")
    # emails, numbers and addresses by the slots they stand in
    place = items.where("kind = 'street_address'").withColumnRenamed("sur", "word")
    rest = items.where("kind in ('email', 'phone', 'id_number')").withColumnRenamed("sur", "shape").withColumnRenamed("given", "word")
    once = place.groupBy("doc_id", "turn_no", "start", "place").agg(F.first("word").alias("word"), F.max("cue").alias("cue"))
    numbers = raw.where("kind = 'number'").groupBy(F.col("given").alias("word")).agg(F.sum("turn_no").alias("n"))
    shown = rest.select("kind", "word", "shape").unionByName(once.select(F.lit("street_address").alias("kind"), "word", F.concat(F.lit("address"), "cue").alias("shape")))
    weights = cut(slot_bits(shown, numbers))
    own = F.when(F.col("cue") == 3, bits).otherwise(0.0)  # a cue that names the kind, an address shown whole
    kept = lambda d: d.where(F.col("bits") + own >= -against)
    rest = kept(rest.join(weights, ["kind", "word", "shape"])).select("doc_id", "turn_no", "kind", "start", "stop", "found")
    # towns: phrases that stand where an address shows them whole, seen in two turns or more
    last = F.max("stop").over(_one_place())
    towns = place.withColumn("last", last).where("cue = 3 and stop = last and given <> ''").groupBy(F.col("given").alias("given")).agg(F.count(F.lit(1)).alias("seen"))
    towns = towns.where(F.col("seen") >= least).select("given", F.lit(1).alias("is_town"))
    placed = place.join(towns, "given", "left").withColumn("last", last)
    known = F.col("is_town").isNotNull()
    # the longest end with a known town; else the whole if it is shown, one word of a town, or the street
    one_word = (F.col("cue") >= 1) & (F.col("given") != "") & ~F.col("given").contains(" ")
    rank = F.when(known, 3).when((F.col("cue") == 3) & (F.col("stop") == F.col("last")), 2).when(one_word, 1).otherwise(0)
    placed = placed.withColumn("rank", rank).withColumn("far", F.when(F.col("rank") == 0, -F.col("stop")).otherwise(F.col("stop")))
    best = placed.groupBy("doc_id", "turn_no", "start", "place").agg(F.max_by(F.struct("stop", "found", "cue", "word"), F.struct("rank", "far")).alias("b"), F.max("rank").alias("rank"))
    best = best.where("b.cue >= 1 or rank = 3").select("doc_id", "turn_no", F.lit("street_address").alias("kind"), "start", "b.*")
    best = kept(best.withColumn("shape", F.concat(F.lit("address"), "cue")).join(weights, ["kind", "word", "shape"])).select("doc_id", "turn_no", "kind", "start", "stop", "found")
    # of names that overlap, the longest
    inner, outer = people.alias("i"), people.select("doc_id", "turn_no", F.col("start").alias("s2"), F.col("stop").alias("e2")).alias("o")
    over = (F.col("i.doc_id") == F.col("o.doc_id")) & (F.col("i.turn_no") == F.col("o.turn_no")) & (F.col("s2") < F.col("i.stop")) & (F.col("e2") > F.col("i.start"))
    longer = (F.col("e2") - F.col("s2") > F.col("i.stop") - F.col("i.start")) | ((F.col("e2") - F.col("s2") == F.col("i.stop") - F.col("i.start")) & (F.col("s2") < F.col("i.start")))
    people = inner.join(outer, over & longer, "left_anti").select("doc_id", "turn_no", "kind", "start", "stop", "found")
    return rest.unionByName(best).unionByName(people)


def _one_place():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id", "turn_no", "start", "place")


def found_items(df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns") -> DataFrame:
    """``doc_id, turn_no, kind, found``: the distinct items."""
    return personal_spans(df, id_col, turns_col).select("doc_id", "turn_no", "kind", "found").distinct()


def sanitised_turns(df: DataFrame, id_col: str = "doc_id", turns_col: str = "turns") -> DataFrame:
    """``doc_id, turn_no, text, n_items``: every turn that isn't blank, each item replaced by a placeholder of its kind."""
    spans = personal_spans(df, id_col, turns_col)
    each = spans.groupBy("doc_id", "turn_no").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("items"))
    turns = explode_turns(df, id_col, turns_col).distinct().join(each, ["doc_id", "turn_no"], "left")
    # pieces of text before each item and its placeholder, then the rest
    init = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"),
        x["stop"].alias("at"),
    )
    done = F.aggregate("items", init, step)
    text = F.when(F.col("items").isNull(), F.col("text")).otherwise(F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text"))))
    return turns.select("doc_id", "turn_no", text.alias("text"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))
