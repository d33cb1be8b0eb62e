"""Pairs, look-alikes, names, scans, subjects and mixtures: small cases, edges and held-out accuracy."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casemill.llm import lookalikes, mixing, names, pairs, scans, subjects

QUESTION = "EXTRACT\nThe Panel noted that the wall chart bearing code DA-68960 had been prepared on 25 July 2016 and that Fenwick plc accepted responsibility for all 4249 copies.\n\nQUESTION\nDid the Panel rule a breach of Clause 4.1? Give your reasons in two or three sentences, then the ruling."


def _defects(df, ruling=pairs.RULING):
    return pairs.defects(df, "response_id", "question", "content", ruling, ruling and pairs.RULING_WORDS)


def test_pairs_without_rulings(spark):
    asked = "What is the capital of France, and why was it chosen as the seat of the government? Answer in one sentence or two, please, and say what the sources of the answer are."
    answers = [
        ("The capital of France is Paris.", None),
        ("In short, the article says that the harbour was closed for a month. It reopened in May.", None),
        ("Old pond in the rain,\na frog leaps into the sound,\nand then all is still.", None),
        ("I'm sorry, but I can't help with that.", "refusal"),
        ("Столица Франции — Париж.", "other_language"),
        ("Stolicą Francji jest Paryż, który został wybrany przez królów i od tego czasu nie jest zmieniany, jak podają źródła.", "other_language"),
        ("法国的首都是巴黎。", "other_language"),
        ("The capital of France is Paris and the seat of", "truncated"),
        ("What is the capital of France, and why was it chosen as the seat of the government?", "copies_question"),
    ]
    df = spark.createDataFrame([(k, asked, a) for k, (a, _) in enumerate(answers)] + [(100 + k, asked, "The capital of France is Paris, and the seat of the court was there.") for k in range(30)], "response_id bigint, question string, content string")
    got = {r.response_id: r.defect for r in _defects(df, None).collect()}
    assert got == {k: d for k, (_, d) in enumerate(answers) if d}


def test_a_ruling_of_the_prompt_is_no_answer(spark):
    asked = QUESTION + "\nEnd with a line like this one.\nAnswer: breach"
    own = "The company gave a dated approval trail for it.\nAnswer: breach"
    df = spark.createDataFrame([(1, asked, asked), (2, asked, own), (3, asked, None)], "response_id bigint, question string, content string")
    assert {tuple(r) for r in _defects(df).collect()} == {(1, "copies_question"), (3, "empty")}


def test_contexts_against_a_loop():
    r = random.Random(2)
    words = ["The", "panel", "ruled.", "Answer:", "breach", "3.2", "DA-68", "and", "(b)", "it.”"]
    texts = ["\n".join(" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(r.randint(1, 4))) for _ in range(200)]
    reader, known = pairs._Reader(pairs.RULING, pairs.RULING_WORDS), pairs._Tokens()
    places = [reader.rulings(t) for t in texts]
    counts, keys, after, ended = pairs.contexts(texts, places, known)
    want, last = Counter(), []
    for text, own in zip(texts, places, strict=True):
        at, lines = 0, text.split("\n")
        for k, line in enumerate(lines):
            here = [p - at for p in own if at <= p < at + len(line)]
            before, tokens, pos = "", line.split(" "), 0
            for j, t in enumerate(tokens):
                ruled, shape = bool(here) and pos >= here[0], known.names[known.shape[known[t]]]
                end = j + 1 == len(tokens) or bool(pairs._SENTENCE_END.search(t)) and tokens[j + 1][0].isupper()
                final = k + 1 == len(lines) and j + 1 == len(tokens)
                if not final or ruled:
                    want[f"{ruled:d}|{before}|{shape}", end] += 1
                if final:
                    last.append((f"{ruled:d}|{before}|{shape}", ruled, bool(pairs._SENTENCE_END.search(t))))
                before, pos = shape, pos + len(t) + 1
            at += len(line) + 1
    number = lambda name: int(np.uint64(xxhash.xxh64_intdigest(name)).view(np.int64))
    got = {(k, e): n for k, i, b in counts.itertuples(index=False) for e, n in ((False, i), (True, b)) if n}
    assert got == {(number(name), e): n for (name, e), n in want.items()}
    assert list(zip(keys.tolist(), after.tolist(), ended.tolist(), strict=True)) == [(number(n), a, e) for n, a, e in last]


def test_pair_defects(spark):
    sound = "The company gave a dated approval trail for DA-68960 and the complainant offers nothing that contradicts it.\nAnswer: breach"
    rows = [
        (1, QUESTION, sound),
        (2, QUESTION, "Answer: no_breach, 0.70\nThe company gave a dated approval trail and the complainant offers nothing that contradicts it."),
        (3, QUESTION, '{"rationale": "The trail is dated and complete.", "answer": "breach", "probability": 0.8}'),
        (4, QUESTION, None),
        (5, QUESTION, " ​\n"),
        (6, QUESTION, "{}"),
        (7, QUESTION, "The company gave a dated approval trail for DA-68960 and the compl"),
        (8, QUESTION, '{"rationale": "The trail is dated and'),
        (9, QUESTION, "I'm sorry, but I can't help with deciding this matter."),
        (10, QUESTION, '{"rationale": "With respect, I must decline to answer.", "answer": null}'),
        (11, QUESTION, QUESTION),
        (12, QUESTION, "You asked: " + QUESTION.split("QUESTION\n")[1].lower()),
        (13, QUESTION, "Die Kammer stellte fest, dass die Freigabe von DA-68960 nicht vollständig war und dass der Text geprüft wurde.\nAntwort: Verstoß"),
        (14, None, sound),
        (15, "", sound),
        (16, "Wurde ein Verstoß gegen Ziffer 4.1 festgestellt? Die Kammer hat den Text geprüft und nicht beanstandet.", "Die Kammer stellte fest, dass die Freigabe nicht vollständig war.\nAntwort: Verstoß"),
        (None, QUESTION, ""),
        (1, QUESTION, sound),
    ] + [(100 + k, QUESTION, sound) for k in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "response_id bigint, question string, content string, id string")
    got = {(r.response_id, r.defect) for r in _defects(df).collect()}
    assert got == {(4, "empty"), (5, "empty"), (6, "empty"), (7, "truncated"), (8, "truncated"), (9, "refusal"), (10, "refusal"), (11, "copies_question"), (12, "copies_question"), (13, "other_language"), (None, "empty")}
    assert _defects(df.limit(0)).count() == 0
    ratios = {r.response_id: r.ratio for r in pairs.copy_ratios(df, "response_id", "question", "content").collect()}
    assert ratios[11] < 0.05 < ratios[1] and ratios[4] == ratios[14] == 1


def test_very_long_response(spark):
    df = spark.createDataFrame([(1, QUESTION, "The trail is dated and complete. " * 30_000 + "Answer: breach"), (2, QUESTION * 500, QUESTION * 300)], "response_id bigint, question string, content string")
    assert {tuple(r) for r in _defects(df).collect()} == {(2, "copies_question")}


@pytest.mark.parametrize("length", [2_000, 16_000, 64_000, 100_000])
def test_copies_of_any_part_of_a_prompt(spark, length):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(4000)]
    prompt = " ".join(r.choices(words, k=length // 5))[:length]
    parts = [prompt[:300], prompt[length // 2 :][:300], prompt[-300:], prompt]
    changed = " ".join("other" if k % 20 == 9 else w for k, w in enumerate(prompt[:600].split()))
    own = " ".join("".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9))) for _ in range(60))
    df = spark.createDataFrame([(k, prompt, x) for k, x in enumerate([*parts, changed, own])], "response_id int, question string, content string")
    ratios = {x.response_id: x.ratio for x in pairs.copy_ratios(df, "response_id", "question", "content").collect()}
    assert max(ratios[k] for k in range(5)) <= pairs.COPY_RATIO < ratios[5]
    assert {x.response_id for x in _defects(df).where("defect = 'copies_question'").collect()} == {0, 1, 2, 3, 4}


def test_look_alikes(spark):
    corpus = spark.createDataFrame([("the Panel's ruling of 3.2, first re-use of Topabariéla " * 5,), ("nο ２ ﬁrst ‑ ʼ",), (None,)], "text string")
    rewrite = lookalikes.Rewriter(lookalikes.member_counts(corpus, "text"))
    for seen, meant in (("nο  b‍reаch", "no breach"), ("ﬁrst", "first"), ("３.2", "3.2"), ("Topabariéla", "Topabariéla"), ("е́", "é"), ("re‑use itʼs", "re-use it's"), ("e​́", "é"), ("", ""), ("​", ""), ("a   b\n", "a b")):
        assert rewrite(seen) == meant
        assert rewrite(rewrite(seen)) == rewrite(seen)
    for a, b in (("Topabariela", "Topabariéla"), ("breach", "Breach"), ("l", "1"), ("O", "0"), ("I", "l"), ("ss", "ß")):
        assert rewrite(a) != rewrite(b)
    df = spark.createDataFrame([(1, "nο", 7), (2, None, 8)], "pane_id bigint, text string, t int")
    assert [tuple(r) for r in lookalikes.consistent(df, ["text"], rewrite).orderBy("pane_id").collect()] == [(1, "no", 7), (2, None, 8)]


def test_quotes(spark):
    rewrite = lookalikes.Rewriter({"o": 9, "e": 9, "'": 3, "-": 2, "a": 9})
    quotes = spark.createDataFrame([(1, "f", "nο breach"), (1, "f", "nο breach"), (2, "f", "no Breach"), (3, "g", "no breach"), (4, "f", "​"), (5, None, "no"), (6, "f", None)], "quote_id bigint, file string, quote string")
    places = spark.createDataFrame([(10, "f", "Thus no brеach was ruled."), (11, "g", None), (12, "f", ""), (None, "f", "no breach")], "place_id bigint, file string, text string")
    assert {tuple(r) for r in lookalikes.find_quotes(quotes, places, rewrite).collect()} == {(1, 10)}
    assert lookalikes.find_quotes(quotes.limit(0), places, rewrite).count() == 0


def test_quotes_and_panes_take_one_form(spark, tmp_path):
    from casemill.llm import queries

    spark.createDataFrame([(k, "the Panel’s view") for k in range(9)], "pane_id bigint, text string").write.parquet(f"{tmp_path}/panes.parquet")
    spark.createDataFrame([(1, "the Panel's view"), (2, "the Panel’s view"), (3, None)], "correction_id bigint, quote string").write.parquet(f"{tmp_path}/slot_corrections.parquet")
    quotes = {r.correction_id: r.quote for r in queries.QUERIES["p5_quotes"](spark, str(tmp_path)).collect()}
    panes = {r.text for r in queries.p5_panes(spark, str(tmp_path)).collect()}
    assert set(quotes) == {1, 2, 3} and quotes[3] is None
    assert {quotes[1], quotes[2]} == panes and len(panes) == 1


KNOWN = [(1, "Nordorin Biosciences GmbH"), (2, "Rosdalmoor Consumer plc"), (3, "Rosdalmoor Vaccines plc"), (4, "Pelhamorin Lorimical & Dremontical UK Ltd"), (5, "Halvyxis Healthcare GmbH"), (6, "Yarrinmoor Kestwyck & Brunskella UK Ltd")]


TYPED = [("nordorin biosci.", {1}), ("Nor-dorin", {1}), ("Nor dorin Bioscience Ltd", {1}), ("Nodrorin", {1}), ("Nórdorin plc", {1}), ("Vaccines, Rosdalmoor", {3}), ("ROSDALMOOR CONSUMER HEALTH", {2}), ("Rosdalmoor", set()), ("P.L.D.", {4}), ("PLD UK Ltd", {4}), ("Pelhamorin-Lorimical-Dremontical Limited", {4}), ("Yarrinmoor Brunskella and Kestwyck", {6}), ("Halvyx", {5}), ("Director v Halvyxis H'care", {5}), ("Nordorin / Rosdalmoor Consumer", {1, 2}), ("Nordorin Biosciences GmbH and Yarrinmoor Kestwyck & Brunskella", {1, 6}), ("Anonymous", set()), ("Hospital pharmacist", set()), ("", set()), ("Zephrwyck Pharma", set())]


def _meant(spark, typed, known, kind="bigint"):
    """The ids that each typed name means."""
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(typed)], "field string, record_id bigint, name string")
    got = names.find_entities(rows, spark.createDataFrame(known, f"entity_id {kind}, name string")).collect()
    return [{r.entity_id for r in got if r.record_id == k} for k in range(len(typed))]


def test_names(spark):
    assert dict(zip([t for t, _ in TYPED], _meant(spark, [t for t, _ in TYPED], KNOWN), strict=True)) == dict(TYPED)


def test_names_do_not_depend_on_the_blocks(spark, monkeypatch):
    known = [*KNOWN, (11, "Bremovax"), (12, "Bremovan"), (13, "Keltorin"), (14, "Dravizol")]
    typed = [t for t, _ in TYPED] + ["Bremovan Limited", "Bremovaz", "bremovaxx", "Drvaizol", "Kel torin"]
    want = _meant(spark, typed, known)
    assert want[-5:] == [{12}, set(), {11}, {14}, {13}]
    for size in (1, 2, 5):
        monkeypatch.setattr(names, "INDEX_NAMES", size)
        assert _meant(spark, typed, known) == want
    assert _meant(spark, typed[-5:], [(f"x{k}", n) for k, n in known], "string") == [{f"x{k}" for k in w} for w in want[-5:]]


def test_names_table(spark):
    rows = [("a", 1, "Nordorin"), ("a", 1, "Nordorin"), ("b", 1, "nordorin"), ("a", 2, None), ("a", None, "Nordorin"), ("a", 3, ""), ("a", 4, "Nordorin; Halvyxis"), ("a", 5, "Nordorin plc; " * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "field string, record_id bigint, name string, entity_id string")
    known = spark.createDataFrame([*KNOWN, (None, "x"), (9, None)], "entity_id bigint, name string")
    got = lambda: {tuple(r) for r in names.find_entities(df, known).collect()}
    assert got() == {("a", 1, 1), ("b", 1, 1), ("a", 4, 1), ("a", 4, 5), ("a", 5, 1)}
    assert names.find_entities(df.limit(0), known).count() == names.find_entities(df, known.limit(0)).count() == 0


def _clusters(spark, rows):
    return names.cluster_names(spark.createDataFrame([(r,) for r in rows], "name string"), "name").collect()


def test_name_clusters(spark):
    rows = ["Nordorin Biosciences"] * 5 + ["nordorin biosci.", "Nordorrin Biosciences", "Nor dorin", "Nordor", "Halvyxis", "HALVYXIS plc", None, " "]
    got = _clusters(spark, rows)
    of = {r.form: r.entity for r in got}
    assert {of[f] for f in rows[:9]} == {"Nor dorin"} != {of["Halvyxis"]} == {of["HALVYXIS plc"]}
    assert sum(r.n for r in got) == 11 and _clusters(spark, [None, ""]) == []


def test_name_clusters_of_people_and_firms(spark):
    rows = ["Kelvin Smith Associates", "Smyth Kelvin Assoc", "K. Smith Associates", "Kelvin Jones", "Bob Miller", "Miller, Robert", "Premovax", "Bremovax", "Bremovax", "Dravizol Pharma", "Dravizol Vaccines", "Dravizol Vaccines", "Dravizol Ltd", "Ormont Halder & Quist", "OHQ", "x" * 5000, "x" * 4999 + "y"]
    of = {r.form: r.entity for r in _clusters(spark, rows)}
    assert of["Kelvin Smith Associates"] == of["Smyth Kelvin Assoc"] == of["K. Smith Associates"] != of["Kelvin Jones"]
    assert of["Bob Miller"] == of["Miller, Robert"] and of["Premovax"] == of["Bremovax"] and of["OHQ"] == of["Ormont Halder & Quist"]
    assert of["x" * 5000] == of["x" * 4999 + "y"]
    assert len({of["Dravizol Pharma"], of["Dravizol Vaccines"], of["Dravizol Ltd"]}) == 3  # no group of words has most of the rows


def test_name_clusters_against_the_known_names(spark):
    r = random.Random(5)
    known = ["Pelhamorin Lorimical Dremontical", "Halvyxis Healthcare", "Yarrinmoor Pharma", "Grimsolovar Consumer", "Grimsolovar Vaccines", "Brackenyxis", "Tamberigen Biosciences", "Juverasco"]

    def typed(s):
        words = s.split()
        w = words[0]
        for _ in range(r.choice([0, 1, 1, 2])):
            k = r.randrange(len(w) - 1)
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aeiourstl") + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + r.choice("aeiourstl") + w[k + 1 :]])
        words[0] = w
        return " ".join(r.choice([words, words, words[::-1], [*words, "Ltd"]]))

    rows = [(k, f) for k, s in enumerate(known) for f in [s] * 20 + [typed(s) for _ in range(60)]]
    of = {x.form: x.entity for x in _clusters(spark, [f for _, f in rows])}
    pairs = [(a, b) for a in rows for b in rows if a[1] < b[1]]
    same, mine = [k for k, (a, b) in enumerate(pairs) if a[0] == b[0]], [k for k, (a, b) in enumerate(pairs) if of[a[1]] == of[b[1]]]
    both = len(set(same) & set(mine))
    assert both / len(same) > 0.9 and both / len(mine) > 0.98


def test_name_clusters_link_every_near_pair(spark):
    r = random.Random(8)
    rows = ["morvestaris"] * 125 + ["morvetairs", "morvsetaris", "morrvetaris"]
    for base in ("yarrinumbra", "yamdrinulen", "ruawaldethis", "aldovaris", "nordorin", "pelhamorin lorimical dremontical"):
        for _ in range(40):
            w = base
            for _ in range(r.choice([1, 2, 2, 3])):
                k = r.randrange(1, len(base) - 4)
                w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("adegmrw") + w[k:], w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + r.choice("adegmrw") + w[k + 1 :]])
            rows += [" ".join(sorted(w.split()))] * r.choice([1, 1, 1, 2, 5])
    forms = sorted(set(rows))
    assert not any(a != b and b.startswith(a) for a in forms for b in forms)
    of = {x.form: x.entity for x in _clusters(spark, rows)}
    near = lambda a, b: names.edits(a, b, 2) <= names.NAME_EDITS and names.jaro_winkler(a, b) >= names.NAME_LIKE and any(c == d for c, d in zip(names.codes(a), names.codes(b), strict=True))
    want = {f: f for f in forms}
    for k, a in enumerate(forms):
        for b in forms[k + 1 :]:
            if near(a, b) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {f: low if w == high else w for f, w in want.items()}
    assert of == want


def test_name_clusters_tell_cut_off_words_from_misspelt_ones(spark):
    rows = ["Kirbrandyxis"] * 5 + ["Kirbrandxs", "Kirbrandxsde"] + ["Kirbrandonde"] * 5 + ["Pelhamanto"] * 3 + ["Pelhammoor"] * 3 + ["Pelhama", "Pelhamm"]
    of = {r.form: r.entity for r in _clusters(spark, rows)}
    assert of["Kirbrandxs"] == of["Kirbrandyxis"] != of["Kirbrandxsde"] == of["Kirbrandonde"]
    assert of["Pelhama"] == of["Pelhamanto"] != of["Pelhamm"] == of["Pelhammoor"]


def test_blocks_hold_every_near_pair():
    r = random.Random(6)

    def typo(s):
        k = r.randrange(1, len(s) - 2)
        return r.choice([s[:k] + s[k + 1 :], s[:k] + "e" + s[k:], s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + "o" + s[k + 1 :]])

    for base in ("nuvolvar", "pelhamorin lorimical drem", "yarrinmoor kestwyck brunskella and others"):
        for _ in range(40):
            other = typo(typo(base))
            at, keys = names.block_keys([base, other])
            if any(a == b for a, b in zip(names.codes(base), names.codes(other), strict=True)):
                assert set(keys[at == 0].tolist()) & set(keys[at == 1].tolist()), (base, other)


def test_jaro_winkler():
    assert names.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert names.edits("ca", "abc", 5) == 3 and names.edits("abcd", "acbd", 2) == 1


CLEAN = "The complainant said that the booklet was presented as if it settled the matter, although the randomised trial had been left out. The company denied that the reader would have found it misleading. The decision to re-use the booklet had been an isolated error. The press release was considered by the Panel on appeal. "


def _scan_rows():
    files = []
    for f in ("a", "b", "c"):
        for p in (1, 2, 3):
            odd = "abc".index(f) * 3 + p
            body = ["The complainant said that the booklet was presen-", "ted as if it settled the matter, although the", "randomised tria1 had been left out. The company", "denied that the reader would have found it"]
            if f == "a" and p == 1:
                body = ["PANEL RULING", "The decision to re-", "use the booklet had been an isolated error. The cornpla¬", "inant said that the"]  # the compound keeps its hyphen
            ends = [" ".join(["matter"] * odd) + " was found.", " ".join(["booklet"] * odd) + " was left."]
            if f == "b" and p == 1:
                ends[1] = "denied that the rea"
            if f == "b" and p == 2:
                ends[0] = "der would have found it misleading."
            own = [" ".join([w] * odd) + " was considered." for w in ("reader", "company", "error", "decision")]
            lines = [f"Quarterly Casebook May 2017   {p}", ends[0], *own[:2], *body, *own[2:], ends[1], f"page {p}"]
            files += [(f, p, k + 1, line) for k, line in enumerate(lines)]
    return [(n, f, p, k, t, None) for n, (f, p, k, t) in enumerate(files)]


def test_scan_repair(spark, monkeypatch):
    rows = _scan_rows()
    lines = spark.createDataFrame([(*r, "clash") for r in rows], "line_id bigint, file string, page_no int, line_no int, text string, ends_with_linebreak_hyphen boolean, place string")
    corpus = spark.createDataFrame([(CLEAN * 50,), (None,), ("",)], "text string")
    made = scans.ScanRepair(lines, corpus, "text")
    got = {(r.line_id, r.defect) for r in made.defects().collect()}
    by = {(f, p, k): n for n, f, p, k, _, _ in rows}
    monkeypatch.setattr(scans, "DOUBTS_BROADCAST", -1)  # the other way: doubted words are joined to the pages
    assert {(r.line_id, r.defect) for r in scans.ScanRepair(lines, corpus, "text").defects().collect()} == got
    assert {n for n, d in got if d == "page_furniture"} == {by[f, p, k] for f in "abc" for p in (1, 2, 3) for k in (1, 12)}
    assert (by["a", 1, 7], "broken_word") in got and (by["a", 1, 7], "misread") in got  # cornpla / inant
    assert (by["a", 1, 6], "broken_word") not in got  # re-use keeps its hyphen
    assert (by["b", 1, 11], "broken_word") in got  # without mark, over the page
    assert (by["a", 2, 5], "broken_word") in got and (by["a", 2, 7], "misread") in got
    assert {d for n, d in got if n == by["a", 2, 6]} == set()
    text = " ".join(r.text for r in made.paragraphs().where("file = 'a'").orderBy("paragraph").collect())
    assert "The decision to re-use the booklet had been an isolated error. The complainant said" in text
    assert "randomised trial had been" in text and "Quarterly" not in text and "page 1" not in text


def test_scan_edges(spark):
    schema = "line_id bigint, file string, page_no int, line_no int, text string, ends_with_linebreak_hyphen boolean"
    corpus = spark.createDataFrame([(CLEAN * 50,)], "text string")
    rows = [(1, None, 1, 1, "the tria1 had", None), (2, "f", None, 1, "page 1", None), (3, "f", 1, None, None, None), (4, "f", 1, 1, "", True), (5, "f", 1, 2, "the " * 20_000, False), (None, "f", 1, 3, "x", None), (1, None, 1, 1, "the tria1 had", None)]
    assert {tuple(r) for r in scans.ScanRepair(spark.createDataFrame(rows, schema), corpus, "text").defects().collect()} == {(1, "misread")}
    assert scans.ScanRepair(spark.createDataFrame([], schema), corpus, "text").defects().count() == 0
    assert scans.ScanRepair(spark.createDataFrame(rows[:1], schema), corpus.limit(0), "text").defects().count() == 0


def test_variants_and_shapes():
    for seen, meant in (("cornplainant", "complainant"), ("prachce", "practice"), ("clated", "dated"), ("5upp1ied", "supplied"), ("aueged", "alleged"), ("flrst", "first"), ("tbat", "that"), ("@pproved", "approved"), ("iinused", "unused"), ("nevvsletter", "newsletter"), ("remaininq", "remaining"), ("hfres", "titres")):
        assert scans.misread_groups(seen, meant) and scans.fold(seen) == scans.fold(meant), (seen, meant)
    assert all(scans.fold(meant) == scans.fold(seen) for meant, every in scans.CONFUSIONS.items() for seen in every.split())
    assert scans.misread_groups("same", "same") is None and scans.misread_groups("bcet", "boat") is None and scans.misread_groups("", "a") is None
    assert scans.shape("Quarferly Casebook August 2017") == scans.shape("7   Quarterly Casebook May 2020")
    assert scans.core("'once-daily,") == "once-daily" and scans.core("3.5") == "" and scans.core("@pproved.") == "@pproved"


def test_subjects_held_out(spark):
    rng = random.Random(3)
    topics = {"sea": ["harbour", "sailor", "tide", "anchor"], "farm": ["barley", "tractor", "plough", "cattle"], "law": ["tribunal", "statute", "verdict", "barrister"]}
    filler = ["copies", "letter", "matter", "company", "reply", "morning", "paper", "answer", "person", "office"]

    def sentence(topic=None):
        words = [rng.choice(filler) for _ in range(9)]
        if topic:
            words[rng.randrange(9)] = rng.choice(topics[topic])
        return " ".join(words).capitalize() + "."

    docs, truth = [], {}
    for k in range(400):
        own = set(rng.sample(sorted(topics), rng.choice([0, 1, 1, 2])))
        passing = rng.choice([None, *(set(topics) - own)])
        text = [sentence(t) for t in own for _ in range(rng.randint(2, 4))] + [sentence() for _ in range(4)] + ([sentence(passing)] if passing else [])
        rng.shuffle(text)
        docs.append((k, " ".join(text)))
        truth[k] = own
    docs += [(1000, None), (1001, ""), (1002, "Harbour."), (None, docs[0][1]), docs[1]]
    labels = [(k, s) for k in range(200) for s in sorted(truth[k])] + [(5, None), (None, "sea"), (7, "unknown"), (999999, "sea")]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, subject string")
    marks = spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = subjects.assign_subjects(frame, "doc_id", "text", marks, "doc_id", "subject", ["sea", "farm", "law"]).collect()
    found = {(r.doc_id, r.subject) for r in got}
    assert len(found) == len(got) and not {d for d, _ in found} & {1000, 1001, 1002, None}
    held = {(k, s) for k in range(200, 400) for s in truth[k]}
    mine = {(d, s) for d, s in found if 200 <= d < 400}
    assert len(held & mine) / len(held) > 0.9 and len(held & mine) / len(mine) > 0.9
    assert subjects.assign_subjects(frame.limit(0), "doc_id", "text", marks, "doc_id", "subject", ["sea"]).count() == 0


def test_mixture(spark):
    rng = random.Random(8)
    rows = [(k, rng.choice(["big"] * 8 + ["small", "rare", "other"]), "word " * rng.randint(20, 200)) for k in range(3000)] + [(5000, None, "x y"), (5001, "big", None), (5002, "small", ""), (None, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    counted = mixing.token_counts(docs, "doc_id", "text", "source")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 4), ("rare", 0.1, 2), ("gone", 0.1, 3), ("nil", None, 1), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    made = mixing.Mixture(counted, targets, block_tokens=500)
    report = {r.source: r for r in made.report().collect()}
    scale = 0.9
    for s, share, repeats in (("big", 0.5, 1), ("small", 0.3, 4), ("rare", 0.1, 2)):
        assert report[s].actual_share == pytest.approx(share / scale, abs=0.01) and report[s].most_repeats <= repeats
    assert report["gone"].tokens == 0 and "other" not in report and "nil" not in report
    plan = made.plan().collect()
    assert max(sum(p.doc == d for p in plan if p.source == "small") for d in {p.doc for p in plan if p.source == "small"}) <= 4
    early = [p for p in plan if p.slot < made.slots // 4]
    part = sum(p.tokens for p in early if p.source == "big") / sum(p.tokens for p in early)
    assert part == pytest.approx(0.5 / scale, abs=0.06)
    assert mixing.Mixture(counted.limit(0), targets).plan().count() == 0 and mixing.Mixture(counted, targets.limit(0)).plan().count() == 0
    wide = mixing.Mixture(counted, targets, total_tokens=10**7, block_tokens=500)
    assert {r.source: r.most_repeats for r in wide.report().collect()}["rare"] == 2


def test_van_der_corput(spark):
    got = [r[0] for r in spark.range(8).select(mixing.van_der_corput(F.col("id"))).collect()]
    assert got == [0.0, 0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875]


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2] / "casemill"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "casemill.llm" not in path.read_text()


def test_words_of_other_scripts_keep_their_letters():
    rewrite = lookalikes.Rewriter({"o": 9, "e": 9, "a": 9, "c": 9, "p": 9, "'": 3})
    assert rewrite("the Панель and Ελλάδα stay") == "the Панель and Ελλάδα stay"
    assert rewrite("Пан​ель") == "Панель" and rewrite("сора") == "copa" and rewrite("раnel") == "panel"
    assert rewrite(rewrite("Панель сора")) == rewrite("Панель сора") == "Панель copa"


def test_many_quotes_and_texts_of_one_file(spark, monkeypatch):
    monkeypatch.setattr(lookalikes, "QUOTES_AT_ONCE", 7)
    monkeypatch.setattr(lookalikes, "TEXTS_AT_ONCE", 5)
    r = random.Random(4)
    words = ["panel", "rulіng", "code", "no breach", "casе", "ﬁrst"]
    quotes = [(k, r.choice("fg"), " ".join(r.choices(words, k=2))) for k in range(60)]
    places = [(2**60 + k, r.choice("fff"), " ".join(r.choices(words, k=6))) for k in range(40)]
    rewrite = lookalikes.Rewriter({"i": 5, "e": 5, "fi": 5})
    got = lookalikes.find_quotes(spark.createDataFrame(quotes, "quote_id bigint, file string, quote string"), spark.createDataFrame(places, "place_id bigint, file string, text string"), rewrite).collect()
    assert {tuple(x) for x in got} == {(q, p) for q, f, a in quotes for p, g, b in places if f == g and rewrite(a) in rewrite(b)} and len(got) == len(set(map(tuple, got))) > 50


def test_member_counts(spark):
    texts = ["fi ﬁ ﬃ é ế", "ʼn ŉ ffi", None, "é", "fifi"]
    got = lookalikes.member_counts(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    whole = [t for t in texts if t]
    for m in {c for t in whole for c in t} | {m for c in lookalikes.classes(set()) for m in c if len(m) > 1}:
        assert got.get(m, 0) == sum(t.count(m) for t in whole), ascii(m)


def test_long_words_may_have_more_misreads():
    groups = scans.misread_groups("recornrnendati0ns", "recommendations")
    assert groups and len(groups) == 3 and scans.misread_groups("rn0rn", "mom") is None


def test_corpus_counts(spark, monkeypatch):
    assert scans.corpus_counts(spark.createDataFrame([("",), (" ",), (None,)], "t string").coalesce(1), "t").count() == 0
    texts = ["The trial, the re-use of 3 items.", "", "the", None, "-- !", "trial the trial"]
    for size in (1, 200_000):
        monkeypatch.setattr(scans, "COUNTED", size)
        got = {r.key: r.n for r in scans.corpus_counts(spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1), "t").collect()}
        want = Counter()
        for t in texts:
            cores = [scans.core(w) or ("#" if any(c.isdigit() for c in w) else "") for w in (t or "").split()]
            want.update(c for c in cores if c)
            want.update(f"{a} {b}" for a, b in zip(cores, cores[1:], strict=False) if a and b)
        assert got == dict(want)


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame([(2**60 + 1, QUESTION, ""), (None, QUESTION, ""), (2**60 + 2, QUESTION, QUESTION)], "response_id bigint, question string, content string").coalesce(1)
    assert {tuple(r) for r in _defects(df).collect()} == {(2**60 + 1, "empty"), (None, "empty"), (2**60 + 2, "copies_question")}
    assert {r.response_id for r in pairs.copy_ratios(df, "response_id", "question", "content").collect()} == {2**60 + 1, None, 2**60 + 2}
