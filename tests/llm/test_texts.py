import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeseek.llm import catalogue
from lodeseek.llm.encoding import find_damage, garbled, garbled_ids, restore
from lodeseek.llm.leakage import leaked_passages, leaked_spans
from lodeseek.llm.splitting import RangeMax, cut, oversized_ids, split_lines, split_oversized

# splitting ------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo, len(values) - 1))
    got = RangeMax(np.array(values)).argmax(lo, hi)
    best = max(values[lo : hi + 1])
    assert got == max(i for i in range(lo, hi + 1) if values[i] == best)


TEXT = st.lists(st.sampled_from(["def f():", "    x = 1", "", "}", "é" * 30, "y" * 90, "end", "\r"]), max_size=80).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(8, 200), st.integers(0, 6))
def test_pieces(text, lines, size, overlap):
    pieces = cut(text, lines, size, overlap)
    every = split_lines(text)
    assert all(len(p[3].encode()) <= size and len(split_lines(p[3])) <= lines for p in pieces)
    assert all(p[2] <= overlap for p in pieces) and (pieces == []) == (text == "")
    # without what is shared, the pieces are the text again
    whole = ""
    for a, b, shared, body in pieces:
        at = 0
        if shared:
            while not whole.endswith(body[:at]) or at == 0:
                at += 1
                if at > len(body):
                    break
            at = max(k for k in range(len(body) + 1) if whole.endswith(body[:k]) and (k == 0 or len(re.findall("\n", body[:k])) <= shared + 1))
        whole += body[at:]
    if all(len(x.encode()) <= size for x in every) and len(set(every)) == len(every):
        assert whole == text
    assert all(p[0] <= q[0] and q[1] > p[1] or q[0] >= p[0] for p, q in zip(pieces, pieces[1:]))


def test_cuts_at_natural_places(spark):
    body = "".join(f"def f{i}():\n    a = {i}\n    return a\n\n" for i in range(80))
    pieces = cut(body, 200, 8192, 0)
    assert [p[:2] for p in pieces] == [(0, 199), (200, 319)] and all(p[3].startswith("def ") for p in pieces)
    rows = [("a", 10, body, 1), ("b", 1, "x\n" * 200, 1), ("c", 1, "x\n" * 201, 1), ("d", 1, "é" * 4096, 1), ("e", 1, "é" * 4097, 1), ("f", 1, "", 1), ("g", 1, None, 1), ("h", None, "y\n" * 500, 1), ("c", 1, "x\n" * 201, 1)]
    df = spark.createDataFrame(rows, "id string, start_line int, body string, piece int")
    got = split_oversized(df)
    assert sorted(r.id for r in oversized_ids(got).collect()) == ["a", "c", "e", "h"]
    parts = sorted((r for r in got.collect() if r.id == "h"), key=lambda r: r.piece)
    assert parts[0].start_line == 1 and parts[-1].end_line == 500 and all(q.start_line == p.end_line + 1 - q.shared and q.shared == 5 for p, q in zip(parts, parts[1:]))
    assert min(r.start_line for r in got.collect() if r.id == "a") == 10
    assert split_oversized(df.limit(0)).count() == 0


# leakage --------------------------------------------------------------------------------------


def brute_leaks(docs, items, n=12):
    def spans(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    sp = {j: spans(t) for j, t in items}
    return {(i, j) for i, t in docs for s in [spans(t)] for j in sp if s & sp[j]}


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    items = [(j, " ".join(r.choice(words) for _ in range(r.choice([5, 12, 13, 40])))) for j in range(25)]
    docs = []
    for i in range(80):
        t = [r.choice(words) for _ in range(r.randint(0, 80))]
        if r.random() < 0.6:
            s = r.choice(items)[1].split()
            n = r.choice([10, 11, 12, 13, 20])
            a = r.randrange(len(s))
            t[len(t) // 2 : len(t) // 2] = s[a : a + n]
        docs.append((i, "".join(x + r.choice([" ", "\n// ", ", ", "_"]) for x in t).title()))
    docs += [(900, None), (901, ""), (902, "x " * 50000 + items[-1][1]), (0, docs[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, fp int")
    i = spark.createDataFrame(items + [(77, None)], "item_id long, text string")
    want = brute_leaks(docs, items)
    assert len(want) > 10
    for limit in (2_000_000, 3):
        assert {tuple(x) for x in leaked_passages(d, i, broadcast_limit=limit).collect()} == want
    assert leaked_passages(d.limit(0), i).count() == 0 and leaked_passages(d, i.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaked_passages(d, i, k=13)


# encodings ------------------------------------------------------------------------------------

SENTENCES = ["Die Funktion gibt zurück, ob die Größe größer wird.", "La versión añade el búfer después.", "Où le schéma protège la clé, même si elle a échoué.", "A opção faz com que a ligação contém o número.", "That’s why it isn’t stable — it’s “hot”.", "Функция определяет, когда файл проверяет указатель."]


@pytest.mark.parametrize("text", SENTENCES)
@pytest.mark.parametrize("wrong", ["cp1252", "cp1250", "cp1251", "mac_roman", "cp437"])
def test_round_trip(text, wrong):
    raw = text.encode()
    bad = "".join(bytes([b]).decode(wrong, "replace") if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    if "�" in bad:
        pytest.skip("some bytes have no character there")
    assert find_damage("before\n" + bad) and restore(bad) == text


@pytest.mark.parametrize("text", SENTENCES)
def test_twice_and_clean(text):
    once = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode())
    twice = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in once.encode())
    assert restore(twice) == text and find_damage(text) == [] and restore(text) == text


@pytest.mark.parametrize("text", ["├── a\n│   └── b", "VERSÃO: ATENÇÃO", "900 µs, nº 3, 5 ± 2 °C", "naïve café à la carte", "x\u00a0y", "Ελληνικά", "日本語のテキスト", "", "plain"])
def test_no_damage(text):
    assert find_damage(text) == []


def test_single_byte_cyrillic():
    t = "Функция определяет журнал после проверки указателя"
    assert restore(t.encode("cp1251").decode("cp1252")) == t and restore(t.encode("koi8_r").decode("cp1251")) == t


def test_garbled_rows(spark):
    bad = "zurück".encode().decode("cp1252")
    rows = [(1, bad, "x"), (1, bad, "x"), (2, "zurück", "x"), (3, None, "x"), (4, "", "x"), (5, "lost \ufffd here", "x"), (6, "a" * 100_000 + bad, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    assert sorted(r.id for r in garbled_ids(df).collect()) == [1, 5, 6]
    got = {r.id: r for r in garbled(df).collect()}
    assert got[1].restored == "zurück" and got[5].lost == 1 and got[6].restored.endswith("zurück")
    assert garbled_ids(df.limit(0)).count() == 0


# queries --------------------------------------------------------------------------------------


def test_catalogue_is_consistent():
    names = catalogue.queries()
    assert set(catalogue.oracle_sql()) <= set(names) and all(re.fullmatch(r"p\d+_\w+", n) for n in names)
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 8, 9)} <= set(names) and "p7_containers" in names


def test_restore_goes_on_to_the_end():
    text = garbled_text = "Größe für Bäume"
    for n in range(1, 8):
        garbled_text = garbled_text.encode("utf-8").decode("latin-1")
        assert restore(garbled_text) == text, n
    assert restore(garbled_text, rounds=2) != text


SCRIPTS = [
    "שלום עולם, מה שלומך היום?", "مرحبا بالعالم كيف حالك", "नमस्ते दुनिया आप कैसे हैं", "สวัสดีชาวโลก", "გამარჯობა მსოფლიო", "Tiếng Việt rất hay, người Việt Nam", "Καλημέρα κόσμε, τι κάνεις όλοι;",
    "family 👨‍👩‍👧‍👦 and 🏳️‍🌈 ok", "これは日本語のテキストです。", "안녕하세요 세계", "Բարեւ աշխարհ", "ሰላም ልዑል", "வணக்கம் உலகம்", "Größe über Maß", "Привет, мир",
]


@pytest.mark.parametrize("text", SCRIPTS)
@pytest.mark.parametrize("legacy", ["latin-1", "cp1252", "cp1252 twice"])
def test_scripts_come_back(text, legacy):
    def misread(t):
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) and legacy != "latin-1" else chr(b) for b in t.encode("utf-8"))

    bad = misread(misread(text)) if legacy.endswith("twice") else misread(text)
    assert find_damage(text) == [] and restore(bad) == text
    assert {x.route for x in find_damage(bad)} == {"bytes"}


@pytest.mark.parametrize("text", ["« c'est décidé » hier", "die GRÖẞE „Ö‘ und", "«ЁЛКА», СССР», ПОЛЁТ — КИЇВ", "São Paulo – É–É", "Ü“Ü“ Ö”", "la versión envía el árbol"])
def test_what_only_looks_garbled(text):
    assert find_damage(text) == []


def test_routes(spark):
    rows = [(1, "Ã¼ber"), (2, "Привет, как дела сегодня".encode("cp1251").decode("cp1252")), (3, "a�b"), (4, "itâ€ s Ã©t")]
    got = {r.id: r for r in garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.by_frequency > 0 for k, r in got.items()} == {1: False, 2: True, 3: False, 4: False}


def test_spans_reach_their_ends(spark):
    words = [f"w{i}" for i in range(200)]
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice(["x", "y", "z"]) + str(r.randint(0, 99)) for _ in range(n))
    docs = [(1, noise(7) + " " + " ".join(words[20:120]) + " " + noise(9)), (2, " ".join(words[:12]) + " , " + noise(3) + " " + " ".join(words[:13])), (3, " ".join(words[50:61])), (4, None), (5, "q " * 40)]
    items = [(1, " ".join(words)), (2, " ".join(words[110:150])), (3, "q " * 15)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    for limit in (10_000, 1):
        got = leaked_spans(d, i, broadcast_limit=limit).collect()
        pairs = {tuple(x) for x in got if x.doc_id != 5}
        assert pairs == {(1, 1, 7, 20, 100), (2, 1, 0, 0, 12), (2, 1, 15, 0, 13)}
        # a repeated word: one span for each way the two runs can be laid over each other by 12 words or more
        assert {(x.doc_pos - x.item_pos, x.words) for x in got if x.doc_id == 5} == {(n, min(15, 40 - n) if n >= 0 else 15 + n) for n in range(-3, 29)}
        assert len(got) == 3 + 32
        assert {(x.doc_id, x.item_id) for x in leaked_passages(d, i, broadcast_limit=limit).collect()} == {(1, 1), (2, 1), (5, 3)}
