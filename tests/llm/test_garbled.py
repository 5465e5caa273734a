import numpy as np
import pytest

from shardloom.llm import garbled as G

SENTENCES = [
    "Die Vorrichtung gemäß Anspruch {i} umfasst eine Kühlplatte für große Wärme und höhere Drücke von {i} °C.",
    "Le procédé selon la revendication {i} présente une précision élevée à {i} µm près.",
    "Устройство по п. {i}, в котором корпус имеет линзу и охватывает деталь на {i} мкм.",
    "根据权利要求{i}所述的装置,其中所述阀门具有环形线圈。",
    "The device of claim {i}, wherein the known “Kadel-{i}” arrangement doesn’t wear out at ±{i} kPa.",
]
CLEAN = [(k * 1000 + i, s.format(i=i)) for i in range(60) for k, s in enumerate(SENTENCES)]
CASES = {
    "cp1252": SENTENCES[0].format(i=7).encode().decode("cp1252"),
    "cp1251": SENTENCES[1].format(i=7).encode().decode("cp1251", "replace"),
    "latin": SENTENCES[2].format(i=7).encode().decode("latin-1"),
    "koi8": SENTENCES[2].format(i=7).encode("koi8_r").decode("cp1251"),
    "gbk": SENTENCES[3].format(i=7).encode("gbk").decode("latin-1"),
    "twice": SENTENCES[0].format(i=7).encode().decode("latin-1").encode().decode("latin-1"),
    "passage": "The housing is closed at 5 Â°C and stays so.",
    "lost": "A r�sum� of the claim.",
    "quotes": "The device of claim 3, wherein the known вЂњKadel-3вЂќ arrangement is worn.",
    "tails": "The device of claim 4, wherein the known âKadel-4â arrangement is worn.",
    "controls": "The value \x87\x94? is kept.",
    "reference": SENTENCES[0].format(i=9).encode().decode("latin-1").replace("°", "&deg;"),
}
NOT = ["", " ", None, "It looks for remnants such as “Ã©” or “Â°” in labels.", "gemäss Anspruch", "gem&auml;ß Anspruch 5", "fruher Warme", "x  5", "plain text", "x"]


@pytest.fixture(scope="module")
def found(spark):
    rows = CLEAN + [(9000 + i, t) for i, t in enumerate(CASES.values())] + [(9500 + i, t) for i, t in enumerate(NOT)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, runs string")
    return {r.doc_id: r for r in G.restore(df).collect()}


def test_found(found):
    assert set(found) == {9000 + i for i in range(len(CASES))}


def test_restored(found):
    got = {name: found[9000 + i].restored for i, name in enumerate(CASES)}
    assert got["cp1252"] == SENTENCES[0].format(i=7) and got["latin"] == SENTENCES[2].format(i=7) and got["koi8"] == SENTENCES[2].format(i=7)
    assert got["gbk"] == SENTENCES[3].format(i=7) and got["twice"] == SENTENCES[0].format(i=7) and got["passage"] == "The housing is closed at 5 °C and stays so."
    assert not found[9000 + list(CASES).index("lost")].whole and not found[9000 + list(CASES).index("controls")].whole
    assert got["quotes"] == "The device of claim 3, wherein the known “Kadel-3” arrangement is worn."
    assert got["tails"].startswith("The device of claim 4, wherein the known “Kadel-4")


def test_nothing_else_is_changed(spark):
    bad = SENTENCES[0].format(i=8).encode().decode("latin-1")
    texts = [f"leitf&auml;hig &amp; &#252;blich. {bad} leitf&auml;hig &lt;b&gt; &unknown; It shows “Â°” there.", f"{bad[:40]} f&uuml;r {bad[40:]}"]
    good = [f"leitf&auml;hig &amp; &#252;blich. {SENTENCES[0].format(i=8)} leitf&auml;hig &lt;b&gt; &unknown; It shows “Â°” there.", f"{SENTENCES[0].format(i=8)[:37]}"]
    rows = [(k, t) for k, t in CLEAN] + [(9000 + i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.restored for r in G.restore(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert set(got) == {9000, 9001} and got[9000] == good[0] and "f&uuml;r" in got[9001] and got[9001].startswith(good[1])


def test_order_of_texts_makes_no_difference(spark):
    rows = CLEAN + [(9000 + i, t) for i, t in enumerate(CASES.values())]
    a, b = (sorted(map(tuple, G.restore(spark.createDataFrame(x, "doc_id bigint, text string").coalesce(1)).collect())) for x in (rows, rows[::-1]))
    assert a == b


def test_empty(spark):
    assert G.restore(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    assert G.restore(spark.createDataFrame([(1, None), (2, "ascii")], "doc_id bigint, text string")).collect() == []


def test_segments():
    r = np.random.default_rng(1)
    for _ in range(200):
        x = r.integers(-5, 6, r.integers(0, 40)).astype(float)
        got = G.maximal_segments(x)
        assert all(a < b and s == x[a:b].sum() and s > 0 for a, b, s in got)
        best = max((x[a:b].sum() for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=0)
        assert max((s for *_, s in got), default=0) == max(best, 0)
