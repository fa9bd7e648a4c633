import random
import unicodedata as U


from lexloom.llm import canonical as C
from lexloom.llm import charform as H
from lexloom.llm import leaks as K
from lexloom.llm import markup as M
from lexloom.llm import mojibake as E
from lexloom.llm import queries as Q

# ---- consistent forms


def forms(spark, values):
    df = spark.createDataFrame([(v, "x") for v in values], "text string, form string").drop("form")
    got = {r["text"]: r["form"] for r in H.consistent_forms(df).collect()}
    return [got.get(v, v) for v in values]


def test_forms(spark):
    cases = {
        "bruzoth\u0435ld": "bruzotheld", "ｐｅｅｐ－ｌｉｋｅ": "peep-like", "e\u0301a": "éa", "\u00a0x\u3000y\u2007": "x y", "a\u00adb\u200b": "ab", "\u200b": "",
        "\u0433\u044f\u043cy": "\u0433\u044f\u043c\u0443", "\u03bc\u03bfo\u03c2": "\u03bc\u03bf\u03bf\u03c2", "ﾎﾟ": "ポ", "ホ\u309a": "ポ", "a\u0307\u0323": "\u1ea1\u0307", "\u212b": "Å",
        "\u1112\u1161\u11ab\u1100\u1173\u11af": "\ud55c\uae00", "\ue000a\u0301\ue000\u00a0b\u00a0": "\ue000\u00e1\ue000 b", "a\u0301\u0302\u0323": "\u1ea1\u0301\u0302", "\u0301a\u034fb": "\u0301ab", "x \u00a0 \u3000": "x  ",
        "plain": "plain", " tab\t\n": " tab\t\n", "": "", None: None, "naïve": "naïve", "русский": "русский", "a\u2010b\u2011c": "a-b-c", "x\u00a0 ": "x ",
    }
    assert forms(spark, list(cases)) == list(cases.values())
    assert H.consistent_forms(spark.createDataFrame([], "text string")).count() == 0


def test_forms_against_library(spark):
    rnd = random.Random(1)
    pool = ["e", "o", "\u0301", "\u0323", "\u0308", "\u0327", "é", "ａ", "ﾊ", "\u3099", "カ", "\u200d", " ", "-", "ộ"]
    values = list({"".join(rnd.choice(pool) for _ in range(6)) for _ in range(150)})

    def want(s):
        s = "".join(c for c in s if U.category(c) != "Cf")
        return U.normalize("NFC", "".join(U.normalize("NFKC", c) if U.decomposition(c).startswith(("<wide>", "<narrow>")) else c for c in s))

    assert forms(spark, values) == [want(v) for v in values]


# ---- encodings


def model():
    text = "größe über straße schön für mädchen wörterbuch grün bäume äpfel häuser " * 30
    pairs: dict = {}
    for w in text.split():
        for a, b in zip("^" + w, w):
            pairs[a, b] = pairs.get((a, b), 0) + 50.0
    return E.Language(pairs)


def test_undo_every_chain():
    for written, read, word in (("utf-8", "cp1252", "größe"), ("utf-8", "cp1251", "größe"), ("utf-8", "mac_roman", "größe"), ("utf-8", "gbk", "größe"), ("cp1251", "cp1252", "словарь"), ("koi8-r", "cp1251", "словарь"), ("iso8859-2", "latin-1", "słownik"), ("gbk", "latin-1", "词典"), ("shift_jis", "cp1252", "モユソガキ"), ("utf-16-le", "utf-16-be", "hello")):
        garbled = word.encode(written).decode(read)
        assert word in [got for _, got in E.candidates(garbled)], (written, read)
    twice = "é".encode().decode("cp1252").encode().decode("cp1252")
    assert "é" in [got for _, got in E.candidates("caf" + twice)[-9:] for got in [got[3:]]]


def test_evidence_and_repair():
    lm = model()
    garbled = "gr\u00c3\u00b6\u00c3\u009fe"
    up, even = E.evidence("ein " + garbled, lm), E.evidence("schön", lm)
    assert up[0] > 5 and max(even) <= 0.0
    assert E.repair("ein " + garbled, 0, lm) == "ein größe" and E.repair("x", E.K - 1, lm) == "x"
    assert E.evidence("ascii only", lm) is None and E.evidence("a\ufffdb", lm)[E.K - 1] == E.SURE


def test_pooling(spark):
    """Weak evidence of a source decides together; intact sources and nulls stay."""
    rnd = random.Random(7)
    pl = ["męka", "ręka", "łąka", "wąż", "głęboki", "śnieg", "źródło", "książka", "pięć", "tęcza", "dąb", "sędzia"]
    rows = []
    for s in ("a", "b", "c"):
        for k in range(120):
            w = rnd.choice(pl) + rnd.choice(["", "mi", "owy"])
            rows.append(("t", k + 1000 * "abc".index(s), s, "pl", w if s != "c" else w.encode("iso8859-2").decode("latin-1")))
    rows += [("t", 5000, "a", "pl", None), ("t", 5001, "a", "pl", "plain"), ("t", 5002, None, None, "x\ufffdy")]
    df = spark.createDataFrame(rows, "src string, row_id long, source string, lang string, text string")
    bad, counts = E.find_damaged(df)
    got = {r["row_id"]: r["chain"] for r in bad.collect()}
    damaged = {r[1] for r in rows if r[2] == "c" and not r[4].isascii()} | {5002}
    assert damaged == set(got)
    fixed = {r["row_id"]: r["restored"] for r in E.repaired(df.join(bad, ["src", "row_id"]), counts).collect()}
    want = {r[1]: r[4].encode("latin-1").decode("iso8859-2") for r in rows if r[2] == "c" and r[1] in damaged}
    assert sum(fixed[k] == v for k, v in want.items()) / len(want) > 0.95
    assert E.find_damaged(df.limit(0))[0].count() == 0


def test_models_learn_from_all_fields(spark, tmp_path):
    """Letters that only bodies have, markup around them, tell damage in bodies and headwords; p3 leaves out what p4 finds."""
    rnd = random.Random(5)
    pl = ["męka", "ręka", "łąka", "wąż", "głęboki", "śnieg", "źródło", "książka", "pięć", "tęcza", "dąb", "sędzia"]
    bodies, index = [], []
    for s in ("a", "b", "c"):
        for k in range(120):
            n = k + 1000 * "abc".index(s)
            w = rnd.choice(pl) + rnd.choice(["", "mi", "owy"])
            bodies.append((n, s, f'<div class="x">[{k}] {w if s != "c" else w.encode("iso8859-2").decode("latin-1")}</div>'))
            h = "stol" if s != "c" or k >= len(pl) else pl[k].encode("iso8859-2").decode("latin-1")
            index.append((n, s, h, h))
    titles = [(k, s, "mdx", "pl", "publisher", "tytul") for k, s in enumerate("abc")]
    for name, rows, schema in (
        ("aggregate_section", bodies, "section_id long, dict_id string, body string"), ("mdx_index", index, "id long, dict_id string, text string, normalized string"),
        ("dict_header", titles, "header_id long, dict_id string, kind string, lang string, origin string, title string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r["src"], r["row_id"]) for r in Q.p4_found(spark, str(tmp_path)).collect()}
    want = {("aggregate_section", n) for n, s, body in bodies if s == "c" and not body.isascii()} | {("mdx_index", n) for n, _, h, _ in index if not h.isascii()}
    assert got == want
    fixed = {r["id"]: r["text"] for r in Q.p3_forms(spark, str(tmp_path)).collect()}
    assert [fixed[2000 + k] for k in range(len(pl))] == pl


def test_trusted():
    for word, lang, want in (
        ("męka", "pl", True), ("/ˈkɛvuːz/", "en", True), ("/ˈkɛvuːz/", "ru", True), ("Пётр", "ru", True), ("word", "ru", False), ("[12]", "ru", True), ("_word_", "en", True),
        ("grÃ¶ÃŸe", "de", False), ("freƒôrt", "en", False), ("/Ààgəðɔ/", "en", False), ("x²", "en", False), ("слово", "pl", False),
    ):
        assert E.trusted(word, lang) is want, (word, lang)


def test_repair_takes_the_nearest_where_none_is_better():
    lm = lambda word: {"mêka": -5.0, "męka": -5.5, "lêk": -5.0, "lęk": -9.0}.get(word, -1.0)
    z = E.CHAINS.index((("iso8859-2", "cp1252"),))
    assert E.repair("mêka", z, lm) == "męka" and E.repair("lêk mêka", z, lm) == "lêk męka"


# ---- leaks

ITEM = "At dawn 119 sleepless drummers woke Breadreaslo and demanded clumsy kites from old Houskeprar."


def test_disguises():
    words = K.plain_words(ITEM)
    for text in (
        ITEM.upper(), ITEM.replace(" ", "\n> "), ITEM.replace("drummers", "drum-\nmers"), "<p>" + ITEM.replace("clumsy", "<b>clumsy</b>").replace(" kites", "&nbsp; kites") + "</p>",
        ITEM.replace("e", "\u0435"), ITEM.replace("dawn", "d\u00adawn\u200b"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM), ITEM.replace("clumsy", "**clumsy**").replace("woke", "_woke_"),
    ):
        assert K.plain_words(text) == words


def test_simhash_blocks_find_all_within_radius():
    rnd = random.Random(3)
    items = K.Items([1], [ITEM])
    import numpy as np

    base = items.prints
    flips = []
    for p in base.tolist():
        for _ in range(20):
            for b in rnd.sample(range(64), rnd.randint(0, K.RADIUS)):
                p ^= 1 << b
            flips.append(p)
    a, b = items.candidates(np.array(flips, np.uint64))
    want = {(i, j) for i, x in enumerate(flips) for j, y in enumerate(base.tolist()) if bin(x ^ y).count("1") <= K.RADIUS}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_leaks_against_brute_force():
    """Random texts over few words: pairs and longest runs as by comparing everything with everything."""
    rnd = random.Random(5)
    word = lambda: rnd.choice(["ta", "ke", "mo", "lu", "zi"])
    for least in (1, 3, 8):
        texts = [[word() for _ in range(rnd.randrange(30))] for _ in range(6)]
        items = K.Items(list(range(6)), [" ".join(t) for t in texts], least)
        docs = [[rnd.choice([word(), word(), "other"]) for _ in range(rnd.randrange(25))] + rnd.choice(texts)[rnd.randrange(4) :][: rnd.randrange(20)] for _ in range(60)]
        for d, found in zip(docs, items.leaks(docs)):
            want = {}
            for i, t in enumerate(texts):
                row, best = [0] * (len(t) + 1), 0
                for x in d:
                    row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(t)]
                    best = max(best, *row)
                if best >= least:
                    want[i] = best
            assert set(found) == set(want)
            assert all(found[i] <= want[i] for i in found) and all(found[i] >= least for i in found)


def test_run_reaches_over_the_whole_passage():
    words = K.plain_words(ITEM)
    items = K.Items([1], [ITEM])
    assert items.leaks([["x", *words, "y"]]) == [{1: len(words)}] and items.leaks([words[3:12] + ["x"]]) == [{1: 9}] and items.leaks([words[:7], []]) == [{}, {}]


def test_leaks(spark):
    seven, eight = " ".join(ITEM.split()[:7]), " ".join(ITEM.split()[2:10])
    docs = spark.createDataFrame([(1, "x " + eight.upper() + " y", 0), (2, seven + " but not more", 0), (3, None, 0), (4, "", 0), (5, ITEM + " " + ITEM, 0), (6, "z " * 50_000 + ITEM, 0), (5, ITEM, 1)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "too short")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in K.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 10), (5, 10), (5, 10), (6, 10)]
    blocks = sorted((r["doc_id"], r["item_id"]) for r in K.find_leaks(docs, "doc_id", "text", items, "item_id", "text", max_items=1).collect())
    assert blocks == got
    assert K.find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


# ---- canonical list

NAMES = ["trugîcheèlk", "pluachöston feasiovaild", "túasmeibast-droziopreel", "Küahöpirm", "mabulior"]


def test_resolver():
    r = C.Resolver(list(range(1, 6)), NAMES)
    cases = {
        "TRUGICHEELK": 1, "the trugîcheèlk": 1, "trugîcheèlk (v.)": 1, "trugicheelks": 1, "trugîchelk": 1, "rtugîcheèlk": 1, "tru gicheelk": 1, "trugîch\u200beèlk\u00a0": 1,
        "feasiovaild, pluachöston": 2, "pluachöston%20feasiovaild": 2, "pluachoston feasiovald": 2, "tuasmeibast droziopreel": 3, "das Kuahöpirm [1]": 4, "mabul\u0456or": 5,
        "tru\u00c3\u00a9": 0, "no 78574": 0, "/css/mabulior.css": 0, "unrelated word": 0, "mabulior feasiovaild": 5, "the mabulior of kings": 5, "see mabulior in town": 5, "feasiovaild other": 0, "xmabuliorxyz": 0, "x": 0, "...": 0, "mabulior\n": 5,
    }
    assert {v: r(v)[1] for v in cases} == cases


def test_short_values_and_token_sets():
    r = C.Resolver([1, 2, 3, 4], ["cat", "oak", "red oak tree", "ab"])
    cases = {"cta": 1, "okk": 2, "ca": 1, "ct": 0, "tree, oak red": 3, "tre oka red": 3, "redoaktree": 3, "red oak": 2, "ab": 4, "ba": 0, "xx": 0, "": 0}
    cases |= {"ca": 0}  # two letters of three: too short for an edit
    assert {v: r(v)[1] for v in cases} == cases


def test_edits_against_brute_force():
    rnd = random.Random(2)

    def brute(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(2000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(7))) for _ in range(2))
        assert C.edits(a, b, 3) == min(brute(a, b), 4)


def test_mentions_do_not_overlap():
    r = C.Resolver([1, 2, 3], ["red car", "car", "red"])
    assert [r.names[i] for *_, i in r.mentions("a red car and a car")] == ["red car", "car"]


def test_map_values(spark):
    values = spark.createDataFrame([("s", 1, "Mabulior!", 1), ("s", 2, None, 1), ("s", 3, " ", 1), ("s", 4, "mabulior", 1), ("s", 5, "zzz", 1), ("s", 5, "zzz", 1)], "src string, row_id long, value string, ref_id int")
    names = spark.createDataFrame(list(enumerate(NAMES, 1)) + [(9, None)], "ref_id long, canonical string")
    want = [("s", 1, 5), ("s", 5, 0), ("s", 5, 0)]
    for block in (2, 100):
        got = sorted((r["src"], r["row_id"], r["ref_id"]) for r in C.map_values(values, names, "ref_id", "canonical", block=block).collect())
        assert got == (want if block == 100 else want[:2])  # blocks are merged per row
    assert C.map_values(values.limit(0), names, "ref_id", "canonical").count() == 0
    assert {r["ref_id"] for r in C.map_values(values, names.limit(0), "ref_id", "canonical").collect()} == {0}


# ---- markup

PAGES = [
    '<div class="e"><span class="hwd">w</span> <i>noun</i><ol><li class="sense">One thing.</li></ol></div>', "== w ==\n'''w''' ''noun''\n# One thing.\n# See [[x|y]].",
    "# w\n\n**noun** /x/\n\n- One thing.\n- `w`", "\\section{w}\n\\textbf{w} \\emph{noun}\n\\begin{itemize}\n\\item One.\n\\end{itemize}", "w /x/ noun. Plain text of one kind.",
]


def test_carried():
    m = M.train(PAGES * 20)
    cases = {
        "a <b>x</b>": ["html"], "a &#47;x&#47;": ["html"], "half </i> tag": ["html"], "&lt;table&gt;&lt;/table&gt;": ["html"], "x [t](u.md)": ["markdown"], "**b** _i_": ["markdown"],
        "x [[y]]": ["wiki"], "== h ==\n# item": ["wiki"], "# h\n- x": ["markdown"], "* a\n** [[b|c]]": ["wiki"], "$a^{2}$": ["latex"], "\\emph{x}": ["latex"], "<p>a $x_{1}$</p>": ["html", "latex"],
        "x < y and y > 3": [], "cost $5 then and $9 today": [], "From *old, unknown": [], "snake_case_name": [], "C:\\lex\\97": [], "3 * 4 = 12": [], "#4 [sic] & kin": [], "<= 2; ~40 %": [],
        "@@@LINK=a_b": [], "@@@LINK=x\r\n<p>x</p>": ["html"], "": [], "```toml\na = 1\n```": ["markdown"], "| a | b |\n| --- | --- |\n| c | d |": ["markdown"], "{| class=\"f\"\n|-\n| a || b\n|}": ["wiki"],
        '<iframe srcdoc="== h ==\n# a"></iframe>': ["html", "wiki"], "<script>if(n<3){x=\"# y\"}</script>": ["html"],
    }
    assert {t: M.carried(t, m) for t in cases} == cases


def test_marginals_against_enumeration():
    """Sum-product equals the sum over all labellings on small trees."""
    from itertools import product

    m = M.train(PAGES * 20)

    def flat(n, parent, out):
        k = len(out)
        out.append((n.kind, parent))
        for c in n.children:
            flat(c, k, out)
        return out

    for text in ("# a", "<p># a</p>", "'''x''' # b"):
        root = M.parse(text)
        nodes = flat(root, None, [])
        assert len(nodes) <= 6
        total = {}
        for labels in product(range(5), repeat=len(nodes)):
            p = m.prior[labels[0]]
            for (kind, parent), k in zip(nodes, labels):
                p *= m.emission[kind][k] * (m.edge[labels[parent]][k] if parent is not None else 1.0)
            for i, k in enumerate(labels):
                total[i, k] = total.get((i, k), 0.0) + p
        want = sorted((kind, tuple(round(total[i, k] / sum(total[i, j] for j in range(5)), 6) for k in range(5))) for i, (kind, _) in enumerate(nodes))
        got = sorted((kind, tuple(round(x, 6) for x in v)) for kind, v in m.marginals(root))
        assert set(got) == set(want)


def test_clean(spark):
    m = M.train(PAGES * 20)
    assert M.clean(PAGES[0], m) == "w noun\n\n- One thing."
    assert M.clean(PAGES[1], m) == "## w\nw noun\n- One thing.\n- See y."
    assert M.clean("# w\n```toml\n# no heading\n```\n**b**", m) == "# w\n```toml\n# no heading\n```\nb"
    assert M.clean("\\section{w}\n\\[ x_{1} \\]", m) == "# w\n\\[ x_{1} \\]"
    assert M.clean("<table><tr><td>a</td><td>b</td></tr></table>", m) == "| a | b |"
    assert M.clean(None, m) is None and M.clean("", m) == "" and M.clean("a < b", m) == "a < b"
    df = spark.createDataFrame([("s", 1, "<b>x</b>", "q"), ("s", 2, None, "q"), ("s", 1, "<b>x</b>", "q")], "src string, row_id long, text string, markup string")
    assert sorted(tuple(r) for r in M.find_markup(df, m).collect()) == [("s", 1, "html")] * 2
    assert {(r["row_id"], r["text"]) for r in M.clean_texts(df, m).collect()} == {(1, "x"), (2, None)}
    assert M.find_markup(df.limit(0), M.train([])).count() == 0
