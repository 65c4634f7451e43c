import pytest

from tracewright.llm import language, personal, quality, residue, subjects

CHAT = "doc_id string, turns array<string>, language_primary string"


def chat(spark, turns, label="English"):
    rows = [(f"d{i}", t if t is None or isinstance(t, list) else [t], label) for i, t in enumerate(turns)]
    return spark.createDataFrame(rows, CHAT).selectExpr("*", "1 as turn_no", "'x' as text", "2 as kind", "3 as label", "4 as start")


# --- problem 4
@pytest.mark.parametrize("text", [
    "Tell me if the [[INSERT TOPIC HERE]] works", "Dear ________, we write", "Translate ${text} into {tone}", "Hello *|NAME|*, thanks", "[paste your text below this line]",
    "(insert the paragraph about rocks here)", "Act as <userInput> and answer: %question%", "Write a __YOUR TEXT__ note",
])
def test_placeholders(text):
    assert residue.placeholder(text)


@pytest.mark.parametrize("text", [
    "In my template the line `Dear {{ name }}` renders as blank, why?", "Let A = {6, 54} be a set, and [3] the footnote.", "<URL> and <PATH>", "```\n${x} {{y}}\n```", "I saw 5% and 7% today", "[ ] milk\n[x] eggs",
    "def __init__(self): pass", 'What does "{{name}}" mean?', "",
])
def test_no_placeholders(text):
    assert not residue.placeholder(text)


def test_residue(spark):
    page = "404 Not Found\nThe page you asked for does not exist or was moved."
    turns = [page, page, "Lorem ipsum dolor sit amet elit sed", "Please enable JavaScript to continue to Foo.", "bla bla bla bla bla", "Why would a proxy answer 404 Not Found only at night?",
             "How do I show my visitors a hint that they must enable JavaScript?", ["fine words of a user about their garden", None, "", "  "], None, [], "x " * 20_000 + "end of a very long story"]
    got = {(r.doc_id, r.turn_no) for r in residue.found_turns(chat(spark, turns)).collect()}
    assert {("d0", 0), ("d1", 0), ("d2", 0), ("d3", 0), ("d4", 0)} <= got and not {("d5", 0), ("d6", 0), ("d7", 0)} & got
    assert residue.found_turns(chat(spark, turns).limit(0)).count() == 0


def test_phrases_learned_from_the_corpus(spark):
    turns = [f"502 Bad Gateway. Kindly return after tea. (Ray {i}999)" for i in range(4)] + ["Kindly return after tea. (Ray 5999)"]
    got = {r.doc_id for r in residue.found_turns(chat(spark, turns)).collect()}
    assert got == {f"d{i}" for i in range(5)}


def test_phrases_count_in_long_turns(spark):
    phrase, story = "Kindly return after tea.", " ".join(f"word{i} and word{i + 1}" for i in range(30)) + "."
    turns = [f"502 Bad Gateway. {phrase} (Ray {i}999)" for i in range(2)] + [phrase] + [f"{story} {phrase}"] * 5
    got = {r.doc_id for r in residue.found_turns(chat(spark, turns)).collect()}
    assert "d2" not in got and not {f"d{i}" for i in range(3, 8)} & got


def test_long_pages_of_learned_phrases(spark):
    phrases = [f"The {w} of this machine went to bed early again today." for w in ("oven", "lamp", "door", "roof", "wall", "desk", "sink", "yard")]
    turns = [f"502 Bad Gateway. {p} (Ray {i}999)" for p in phrases for i in range(2)] + [" ".join(phrases)]
    assert {r.doc_id for r in residue.found_turns(chat(spark, turns)).collect()} == {f"d{i}" for i in range(17)}


def _conversations(spark, pages):
    """Talks of three turns on a topic of their own; some hold ``pages`` as their second turn."""
    topics = ["garden roses compost", "kernel compiler thread", "violin melody choir", "tennis racket league", "pension mortgage savings", "stew butter oven"]
    rows = []
    for i in range(400):
        a, b, c = topics[i % 6].split()
        k = f"{chr(97 + i % 26)}{chr(97 + i // 26)}"
        turns = [f"Tell me about {a} and {b} in town {k}lor.", f"What of {b} with {c} near {k}lor street?", f"So {c} goes well with {a} for {k}lor folk."]
        if i < len(pages):
            turns[1] = pages[i]
        rows.append((f"d{i:03d}", turns, f"s{i % 3}"))
    return spark.createDataFrame(rows, "doc_id string, turns array<string>, source string")


def test_out_of_place_and_repeated_turns_by_the_corpus_alone(spark):
    page = "Grilled aubergine today. Printer ribbons arrive every Tuesday."
    df = _conversations(spark, [page] * 9)
    got = {(r.doc_id, r.turn_no) for r in residue.residue_turns(df, patterns=False).collect()}
    assert got == {(f"d{i:03d}", 1) for i in range(9)}


def test_repeated_turns_that_are_in_place_stay(spark):
    df = _conversations(spark, ["Tell me about garden and kernel, violin, tennis, pension and stew. The butter is compost."] * 9)
    assert residue.residue_turns(df, patterns=False).count() == 0


def test_unrepeated_turns_out_of_place_stay(spark):
    df = _conversations(spark, ["Grilled aubergine today. Printer ribbons arrive every Tuesday."])
    assert residue.residue_turns(df, patterns=False).count() == 0


def test_heading_against_body():
    assert residue.terms(["error", "ab", "\u4f60", "\u597d"]) == {"error", "\u4f60\u597d"}


def test_residue_of_a_table_without_source_and_repeated_rows(spark):
    df = chat(spark, ["404 Not Found", "404 Not Found"])
    assert residue.residue_turns(df.unionByName(df)).count() == 2


# --- problem 2
@pytest.mark.parametrize("kind, text, found", [
    ("email", "mail a.b+c @ post.x.test now", "a.b+c @ post.x.test"), ("email", "to a.b [at] x [dot] example.", "a.b [at] x [dot] example"), ("email", "to a.b AT x DOT test please", "a.b AT x DOT test"),
    ("phone", "call +1 462-555-0185 now", "+1 462-555-0185"), ("phone", "call (427) 555-0174 now", "(427) 555-0174"), ("phone", "tel ６０８-５５５-０１８０", "６０８-５５５-０１８０"),
    ("phone", "call zero one six three two nine six zero five", "zero one six three two nine six zero five"), ("id_number", "passport no. ZZ10K131734", "ZZ10K131734"), ("id_number", "tax id: 000 22 1231", "000 22 1231"),
    ("id_number", "NIF: 00252992-Y", "00252992-Y"),
])
def test_items(kind, text, found):
    assert (kind, found) in [(k, text[s:e]) for k, s, e, *_ in personal.structured(text)]


@pytest.mark.parametrize("text", ["The package is pinned at wexos@3.25.0 now", "dev@marpra is my prompt", "Timestamps like 1762092373 are", "number 979-6-3704-1809-7 is", "at 192.0.2.94 since build 2.99.996-6731", "", "2024-01-02"])
def test_no_items(text):
    assert personal.structured(text) == []


def test_people_and_places(spark):
    turns = [
        "Mr. Anna Berg agreed. I live at 12 Oak Street, Marlen 00123 now.", "Forward this to Dr. Anna Berg tomorrow.", "My neighbour Carl Dunn left.", "Mr. Carl Dunn and Mr. Berg, Anna agreed.", "Ship it to 7 Elm Road, Marlen 00124.",
        "my neighbour carl dunn left", "The studio is called Silver Moon and the tool Marble Sun.", "Compare 18 Lane swimming with 30 Road races.", "I live at 9 elm road, marlen with two cats.", None, [None, ""],
    ]
    # other words, so that a name's share of slots stands out
    turns += [" ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)}" for k in range(40)) for i in range(20)]
    got = {(r.doc_id, r.kind, r.found) for r in personal.found_items(chat(spark, turns)).collect()}
    assert got == {
        ("d0", "person_name", "Anna Berg"), ("d0", "street_address", "12 Oak Street, Marlen 00123"), ("d1", "person_name", "Anna Berg"), ("d2", "person_name", "Carl Dunn"), ("d3", "person_name", "Carl Dunn"),
        ("d3", "person_name", "Berg, Anna"), ("d4", "street_address", "7 Elm Road, Marlen 00124"), ("d5", "person_name", "carl dunn"), ("d8", "street_address", "9 elm road, marlen"),
    }
    clean = {r.doc_id: r.text for r in personal.sanitised_turns(chat(spark, turns)).collect()}
    assert clean["d3"] == "Mr. <PERSON_NAME> and Mr. <PERSON_NAME> agreed." and clean["d8"] == "I live at <STREET_ADDRESS> with two cats." and clean["d6"] == turns[6]
    assert personal.found_items(chat(spark, turns).limit(0)).count() == 0


def test_numbers_are_weighed_by_the_slots_they_stand_in(spark):
    """The same number after a word that opens orders falls, after one that opens numbers of persons it stays."""
    turns = [f"my order {10000 + i * 37} is late" for i in range(150)] + [f"my passport no. ZZ10K13{1700 + i}" for i in range(6)] + [f"ask {chr(97 + i)}{chr(105 + i)}en about ticket {20000 + i}" for i in range(10)]
    turns += ["my order 431-35-2792 is late", "write down 431-35-2793 please"]
    got = {(r.doc_id, r.kind, r.found) for r in personal.found_items(chat(spark, turns)).collect()}
    assert ("d167", "id_number", "431-35-2793") in got and not {x for x in got if x[0] == "d166"}
    assert {x[0] for x in got} == {f"d{i}" for i in range(150, 156)} | {"d167"}


def test_names_are_found_alike_in_copies_of_a_table(spark):
    base = ["Mr. Anna{0} Berg{0} agreed.", "Forward this to Dr. Anna{0} Berg{0} tomorrow.", "my neighbour anna{0} berg{0} left", "Dr. Strange{0} Loveday{0} came by."]
    other = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)}" for k in range(40)) for i in range(20)]
    make = lambda n: [t.format(chr(97 + c)) for c in range(n) for t in base] + other * n
    few, many = (personal.found_items(chat(spark, make(n))).where("kind = 'person_name'").count() for n in (1, 10))
    assert few >= 4 and many == 10 * few


def test_no_items_in_a_table_without_numbers(spark):
    assert personal.found_items(chat(spark, ["nothing here", None, "", "just words of a user"])).count() == 0


# --- problem 5
@pytest.mark.parametrize("label, code", [("English", "en"), ("en-US", "en"), (" DE ", "de"), ("Français", "fr"), ("Mandarin Chinese", "zh"), ("zh-CN", "zh"), ("unknown", ""), (None, ""), ("N/A", ""), ("Swedish", "swedish")])
def test_labels(label, code):
    assert language.label_code(label) == code


def test_languages(spark, data):
    words = spark.read.parquet(f"{data}/common_words.parquet")
    base = spark.read.parquet(f"{data}/chat_docs.parquet").select("doc_id", "turns", "language_primary")
    en, de, es = "The weather in the old town was better than we had hoped for.", "Das Wetter in der alten Stadt war besser, als wir gehofft hatten.", "El tiempo en la ciudad vieja era mejor de lo que esperaba la gente."
    own = [("x1", [en], "English"), ("x2", [en + "\n" + de], "English"), ("x3", [de], "Spanish"), ("x4", [es], None), ("x5", ['How would I say "muchas gracias" politely to the people here?'], "English"), ("x6", ["404 Not Found"], None), ("x7", None, None), ("x8", [de], "de")]
    got: dict = {}
    for r in language.found_languages(base.unionByName(spark.createDataFrame(own, CHAT)), words).where("doc_id like 'x%'").collect():
        got.setdefault(r.doc_id, set()).add(r.lang_name)
    assert got == {"x2": {"English", "German"}, "x3": {"German"}, "x4": {"Spanish"}}


def test_binding_is_nearly_orthogonal():
    s = language.Space()
    a, b = s.gram("abc").astype(int), s.gram("bca").astype(int)
    assert (a == language.Space().gram("abc")).all() and abs(a @ b) < 6 * language.DIM**0.5


# --- problem 9
COMMON = frozenset("the of and to a in is that it for on with as was i you my if do how can we not be are this so at by or".split())


@pytest.mark.parametrize("form, text", [
    ("list", "My list so far\n- red apples\n- green pears\n- old plums\n- sour cherries"), ("list", "apples; pears x2; plums; figs; old cherries; sour limes"), ("table", "a,b,c\n1,2,3\n4,5,6\n7,8,9"), ("table", "| a | b |\n|---|---|\n| 1 | x |\n| 2 | y |\n| 3 | z |"),
    ("table", "name      size      colour\nbox       12        red\nbag       7         blue\njar       3         green"), ("junk", "/<&?#^&!<|:|?^;&~|: +<^*&>@|!<<<*>%@"), ("junk", "buy now buy now buy now buy now buy now"), ("junk", "a s f a r a s I c a n t e l l t h e"),
    ("junk", "kjdjaedhhqad kwgfkjwkhf wqfqedff ajgqsgaqg gjksd"), ("junk", "b0 c4 35 14 c0 f9 6e fb 54 6f b3 be"), ("prose", "I think that the weather is better than it was, and we can go out for a walk. It is not so cold."),
    ("prose", "We have to buy a few things for the party and I do not want to forget it:\n- milk\n- eggs\nCan you tell me if this is all that we need for the cake, and how much of it?"), ("", ""), ("", " \n"),
])
def test_forms(form, text):
    assert quality.form_of(text, COMMON, frozenset()) == form


def test_statistics(spark):
    words = spark.createDataFrame([("en", w) for w in COMMON] + [(None, None)], "lang string, word string")
    rows = [(1, "a b\na b\n\na b"), (2, None), (3, ""), (4, "x" * 100_000), (1, "a b\na b\n\na b")]
    got = {r.doc_id: r for r in quality.text_quality(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as form", "2 as n_words"), words).collect()}
    assert got[1].n_words == 6 and got[1].n_lines == 3 and got[1].n_paragraphs == 2 and abs(got[1].duplicate_line_ratio - 2 / 3) < 1e-9 and got[2].form is None and got[3].n_chars == 0 and got[4].n_chars == 100_000
    assert quality.found_forms(spark.createDataFrame(rows, "doc_id long, text string").limit(0), words).count() == 0


def test_repetition_in_the_decision():
    line = "click the banner to win a prize with us today now"
    assert quality.form_of("\n".join([line] * 12), COMMON, frozenset()) == "junk"
    para = "We met at the lake and it was so cold that we had to go home. I do not think that this is how it was for you."
    assert quality.form_of("\n\n".join([para] * 2 + ["How can we do this with you, and for how long do we have to be on the road if it is dark?"]), COMMON, frozenset()) == "prose"
    rep = quality.Repetition("a b\na b\n\na b", ["a", "b"] * 3)
    assert abs(rep.duplicate_lines - 2 / 3) < 1e-9 and rep.bigrams == 1.0
    assert quality.form_of("- one pear\n- two figs\n- red plum\n- old lime\n" * 2, COMMON, frozenset()) == "list"


# --- problem 1
def test_areas_without_a_list_have_the_words_of_their_note():
    seeds = subjects.seed_words({"law": None, "bee_keeping": "hives, honey and swarms", "wasps": "nests and swarms"})
    assert seeds["hives"] == "bee_keeping" and seeds["court"] == "law" and "swarms" not in seeds and subjects.weak_areas("honey question", seeds) == ["bee_keeping"]


def test_openers(spark):
    some = spark.createDataFrame([("Please tell me all of it. One cat sat on the please tell mat.",)] * 9 + [("we saw that one cat sat there",)] * 5, "text string")
    assert ("please", "tell") not in subjects.openers_of(some) and ("one", "cat") not in subjects.openers_of(some)
    assert ("could", "you") in subjects.openers_of(spark.createDataFrame([("Could you tell me all of it?",)] * 9, "text string"))


def test_weak_labels():
    assert subjects.weak_areas("question about league table") == ["sport"] and subjects.weak_areas("misc") == [] and subjects.weak_areas(None) == []


def test_subjects(spark):
    law, cook = "the {} court said that the contract of the {} plaintiff was void before the judge", "put the {} dough in the oven and stir the {} soup with butter for a while"
    names = [f"n{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(60):
        t = law if i % 2 else cook
        rows.append((f"d{i}", [". ".join(t.format(names[(i + k) % 40], names[(i * k) % 40]).capitalize() for k in range(4)) + "."], "English"))
        labels.append((f"d{i}", "court ruling" if i % 2 else "onion soup", "labeled") if i % 5 else (f"d{i}", None, "pending"))
    rows += [("m", [law.format("x", "y").capitalize() + ". " + cook.format("x", "y").capitalize() + "."] * 2, None), ("g", ["Nothing at all was ever said there by anybody today."], None), ("e", [], None), ("p", ["404 Not Found"], None), ("z", None, None)]
    df = spark.createDataFrame(rows, CHAT).selectExpr("*", "1 as area", "2 as words")
    lab = spark.createDataFrame(labels + labels[:3], "doc_id string, subject string, label_status string")
    areas = spark.createDataFrame([("law",), ("cooking",), ("general",), (None,)], "area string")
    got: dict = {}
    for r in subjects.found_areas(df, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.area)
    assert all(got[f"d{i}"] == ({"law"} if i % 2 else {"cooking"}) for i in range(60))
    assert got["m"] == {"law", "cooking"} and got["g"] == {"general"} and not {"e", "p", "z"} & set(got)
    assert subjects.found_areas(df.limit(0), lab, areas).count() == 0
    assert subjects.found_areas(df, lab, areas.where("area = 'no such'")).count() == 0
