"""Leaks, mixtures and encoding repair on small texts."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tanisum.llm import leaks, mixture, mojibake

WORDS = "river letter window station forgot always broken captain ticket lantern harbour secret empty tonight followed kitchen promise market".split()
RARE = "moxthoss neluld ostgrom varbrim klyfael dunsket wenznel jarrpluv ixtmox uldvar gromkly faelost sketdun thosvar brimnel pluvost".split()

OTHERS = "zebra quorum jigsaw pyjama oxygen vortex kayak bazaar fjord nymph".split()


def passage(rng, n=40):
    return " ".join(rng.choice(WORDS if rng.random() < 0.7 else RARE) for _ in range(n))


def subtitle(cues):
    return "\r\n\r\n".join(f"{i + 1}\r\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\r\n{c}" for i, c in enumerate(cues))


@pytest.fixture(scope="module")
def items():
    rng = random.Random(2)
    return [(i, passage(rng)) for i in range(12)]


def documents(items):
    """(id, text, item or None)"""
    rng = random.Random(4)
    out = []

    def doc(words, item, sep=None):
        filler = [" ".join(rng.choices(OTHERS, k=6)).capitalize() + "." for _ in range(8)]
        cues = []
        while words:
            k = rng.choice([3, 4, 5])
            cues.append(" ".join(words[:k]))
            words = words[k:]
            if sep:
                cues.append(sep)
        at = rng.randrange(8)
        out.append((len(out) + 1, subtitle(filler[:at] + cues + filler[at:]), item))

    for i, text in items:
        w = text.split()
        doc(w[:12], i)
        doc(w[5:17], i)
        doc(w[:11], None)
        doc(w[20:28], None)
        doc([w[0].upper(), *w[1:15]], i, sep="[dog barking]")
        doc([f"<i>{x}</i>," if k == 3 else x for k, x in enumerate(w[:13])], i, sep="♪ la la la ♪")
        doc(w[8:22], i, sep="Subtitles by team Lumisub")
        bad = w[10:30]
        bad[6] = bad[6].replace("o", "0").replace("e", "c").replace("i", "1")[:1] + bad[6][1:] if len(bad[6]) > 4 else bad[6]
        doc(bad, i)
        doc([*w[:9], "nothing", "whatever", "elsewhere", *w[12:20]], None)
    # what an advert is comes from lines with an address
    out += [(len(out) + k, subtitle(["Quorum zebra.", "Subtitles by Lumisub, www.lumisub.example"]), None) for k in range(1, 8)]
    return out


def test_leaks(spark, items):
    docs = documents(items)
    rows = [(d, t) for d, t, _ in docs] + [(900, None), (901, ""), (902, "a " * 100_000), (None, items[0][1])]
    df = spark.createDataFrame(rows, "doc bigint, txt string").selectExpr("doc", "txt", "1 as id", "'q' as item")
    it = spark.createDataFrame([*items, (77, None), (78, ""), (79, "two words")], "n bigint, text string")
    got = [(r["id"], r["item"]) for r in leaks.leaked(df, it, id_col="doc", text_col="txt", item_col="n", item_text_col="text").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(d, i) for d, _, i in docs if i is not None}


def test_leaks_in_chunks_of_items(spark, items, monkeypatch):
    monkeypatch.setattr(leaks, "ITEMS", 4)
    docs = documents(items)
    df = spark.createDataFrame([(d, t) for d, t, _ in docs], "doc bigint, txt string")
    it = spark.createDataFrame(items, "n bigint, text string")
    got = {(r["id"], r["item"]) for r in leaks.leaked(df, it, id_col="doc", text_col="txt", item_col="n", item_text_col="text").collect()}
    assert got == {(d, i) for d, _, i in docs if i is not None}


def test_no_items_or_texts(spark, items):
    none, some = spark.createDataFrame([], "a bigint, b string"), spark.createDataFrame(items, "a bigint, b string")
    cols = {"id_col": "a", "text_col": "b", "item_col": "a", "item_text_col": "b"}
    assert leaks.leaked(some, none, **cols).count() == 0
    assert leaks.leaked(none, some, **cols).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 2))
def test_damaged_windows_are_found(seed, damage):
    rng = random.Random(seed)
    words = [rng.choice(WORDS + RARE) for _ in range(40)]
    finder = leaks.Finder(leaks.build([" ".join(words)]))
    at = rng.randrange(28)
    mine = words[at : at + 12]
    for k in rng.sample(range(1, 11), damage):
        mine[k] = mine[k][:1] + ("x" if mine[k][1] != "x" else "y") + mine[k][2:]
    other = [rng.choice(OTHERS) for _ in range(10)]
    text = finder.numbers([*other, *mine, *other])
    assert finder.found([text[:0], text]) == [(1, 0)]


def test_spoken_words_only():
    adverts = frozenset(leaks._shapes("Quill"))
    text = "1\n00:00:01,000 --> 00:00:02,000\n{\\an8}<i>Old river</i>\n[DOOR SLAMS]\nPELL: we (sighs) forgot\n\n2\n0:00:03.100 --> 0:00:04.000\nSync & corrections: Quill\n♪ la la la ♪\nla rivière\n"
    assert [w for w in leaks.Spoken(adverts).words(text) if w.strip()] == ["Old", "river", "we", "forgot", "la", "rivière"]


FRENCH = "été déjà garçon mère forêt cœur voilà où être frère après lumière".split()
POLISH = "źródło wrócił książka też góra miłość świat mąż".split()
RUSSIAN = "письмо река солнце вокзал дверь жизнь никогда".split()


def corpus(n=240):
    rng = random.Random(8)
    return [(i, " ".join(rng.choice(lang) for _ in range(12)) + (" — “oui”… ♪" if i % 2 else " ok")) for i, lang in enumerate(random.Random(9).choices([FRENCH, POLISH, RUSSIAN], k=n))]


def test_repair(spark):
    rows = corpus()
    damage = {
        3: lambda t: t.encode("utf-8").decode("latin-1"),
        10: lambda t: t.encode("utf-8").decode("cp437"),
        40: lambda t: t.encode("utf-8").decode("mac_roman"),
    }
    legacy = {"é": ("cp1252", "cp850"), "ł": ("cp1250", "cp1252"), "ь": ("cp1251", "latin-1")}
    bad, want = [], {}
    for i, t in rows:
        u = t
        if i in damage:
            u = damage[i](t)
        elif i in (50, 51, 52, 53, 54):
            pair = next((p for c, p in legacy.items() if c in t), None)
            if pair and not any(c in t for c in "—“”…♪"):
                try:
                    u = t.encode(pair[0]).decode(pair[1])
                except UnicodeError:
                    u = t
        elif i == 70:
            u = "".join("�" if c in "éàèêçœźłóńąęąś" else c for c in t)
        if u != t:
            want[i] = t
        bad.append((i, u))
    df = spark.createDataFrame([*bad, (800, None), (801, ""), (None, "Ã©tÃ©"), (802, "plain ascii? yes")], "doc bigint, body string").selectExpr("doc", "body", "'t' as text")
    got = {r["id"]: (r["text"], r["n_damaged"]) for r in mojibake.restored(df, id_col="doc", text_col="body").collect()}
    assert set(got) == set(want)
    whole = [i for i in want if i != 70]
    assert [got[i][0] for i in whole] == [want[i] for i in whole]
    assert all(n > 0 for _, n in got.values())


def test_words_of_one_token_through_different_channels():
    words = {"été": 40, "góra": 40, "мама": 30}
    lex = mojibake.Lexicon(words, {c: 50 for c in "éóмамa"}, 100)
    one, two = "été".encode().decode("latin-1"), "góra".encode().decode("cp437")
    assert mojibake.judge(f"{one}-{two}", lex)[:2] == ("été-góra", True)
    # a part that is as it was written
    assert mojibake.judge(f"{one}-góra", lex)[:2] == ("été-góra", True)
    assert mojibake.judge("été-góra", lex)[:2] == ("été-góra", False)


@pytest.mark.parametrize("by_name", [200_000, 40])
def test_rare_words_are_counted_too(spark, monkeypatch, by_name):
    monkeypatch.setattr(mojibake, "LEXICON", by_name)
    docs = [(i, t) for i, t in corpus()] + [(500, "źrebięta źrebięta"), (501, "źrebięta")]
    lex = mojibake.lexicon(spark.createDataFrame(docs, "id long, text string"))
    assert lex.docs == len(docs) and lex.count("źrebięta") == 2 and lex.count("ąąąą") == 0
    assert lex.count("été") == sum("été" in t.split() for _, t in corpus())


def test_words_beyond_the_named_ones_restore_the_same(spark, monkeypatch):
    docs = [*corpus(), (500, "źrebięta déjà"), (501, "źrebięta źrebięta"), (506, "źrebięta"), (502, "źrebi?ta forêt"), (502, "plain"), (503, "źrebięta-été".encode().decode("latin-1")), (504, "książka źrebięta".encode("cp1250").decode("cp1252"))]
    docs.append((505, "źrebięta".encode().decode("latin-1") + "-" + "góra".encode().decode("cp437")))
    df = spark.createDataFrame(docs, "id long, text string")
    want = sorted(mojibake.restored(df, id_col="id", text_col="text").collect())
    assert (502, "źrebięta forêt", 1) in want and {r["id"] for r in want} == {502, 503, 504, 505}
    monkeypatch.setattr(mojibake, "LEXICON", 40)
    assert sorted(mojibake.restored(df, id_col="id", text_col="text").collect()) == want


def test_no_texts(spark):
    none = spark.createDataFrame([], "a bigint, b string")
    assert mojibake.restored(none, id_col="a", text_col="b").count() == 0


def test_paths_are_round_trips():
    for read in mojibake._READ:
        for text in ("forêt", "źródło", "письмо"):
            seen = "".join(mojibake._CHARS.get(read, mojibake._characters(read))[b] for b in text.encode())
            assert text in {p for p, _ in mojibake.paths(seen)}


def test_shares():
    assert mixture.shared_out(10, [1, 1], [100, 100]) == [5, 5]
    assert mixture.shared_out(10, [1, 1], [2, 100]) == [2, 8]
    assert mixture.shared_out(10, [1, 1, 0], [2, 3, 50]) == [2, 3, 0]


def test_shortages_go_to_siblings_first():
    leaves = [{"source": s, "l0": k, "tokens": t, "capacity": float(c)} for s, k, t, c in (("a", "x", 50, 50), ("a", "y", 50, 200), ("b", "x", 100, 1000))]
    # source a needs 120: x lacks some, y of the same source gives it
    assert mixture.budgets(leaves, ["source", "l0"], {"a": 0.5, "b": 0.5}, 240) == [50, 70, 120]


SHARES = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)]


def mixed(spark, n=600, **more):
    rng = random.Random(6)
    docs = [(i, passage(rng, rng.randrange(3, 30)), rng.choices(["a", "b", "c", "d", None], [6, 2, 1, 1, 1])[0], rng.choice(["en", "EN", "de", None])) for i in range(n)]
    docs += [(9000, None, "a", "en"), (9001, "", "b", None)]
    df = spark.createDataFrame(docs, "doc bigint, txt string, source string, lang string").selectExpr("*", "5 as id", "'z' as text")
    w = spark.createDataFrame(SHARES, "source string, target_share double, max_repeats bigint")
    return mixture.mixture(df, w, id_col="doc", text_col="txt", source_col="source", below=["lang"], **more)


@pytest.mark.parametrize("stretch", [5_000, 20])
def test_mixture_reaches_its_shares(spark, stretch, monkeypatch):
    monkeypatch.setattr(mixture, "STRETCH", stretch)
    got, report = mixed(spark)
    rows, report = got.collect(), {r["source"]: r for r in report.collect()}
    assert Counter(r["id"] for r in rows).most_common(1)[0][1] == 1
    limit = {s: m for s, _, m in SHARES}
    assert all(1 <= r["n_used"] <= limit[r["source"]] for r in rows)
    for s, share, _ in SHARES:
        assert abs(report[s]["actual_share"] - share) < 0.02
        assert report[s]["tokens"] == sum(r["n_tokens"] * r["n_used"] for r in rows if r["source"] == s)


def test_mixture_is_seeded(spark):
    one, two, other = (sorted((r["id"], r["n_used"]) for r in mixed(spark, seed=s)[0].collect()) for s in (1, 1, 2))
    assert one == two != other


def test_mixture_beyond_what_there_is(spark):
    got, report = mixed(spark, total=10**9)
    used = {r["source"]: (r["most_used"], r["tokens"], r["available"]) for r in report.collect()}
    assert all(used[s] == (m, m * used[s][2], used[s][2]) for s, _, m in SHARES)


def test_empty_mixture(spark):
    none = spark.createDataFrame([], "doc bigint, txt string, source string, lang string")
    w = spark.createDataFrame(SHARES, "source string, target_share double, max_repeats bigint")
    got, report = mixture.mixture(none, w, id_col="doc", text_col="txt", source_col="source", below=["lang"])
    assert got.count() == 0 and {(r["source"], r["tokens"]) for r in report.collect()} == {("a", 0), ("b", 0), ("c", 0)}


def test_block_hashes_change_in_one_block_only():
    h = np.arange(1, 20, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = leaks.block_hashes(h)
    h[7] += np.uint64(12345678901234567)
    b = leaks.block_hashes(h)
    assert set(np.flatnonzero(a != b)) <= {6, 7}
    # the order counts
    assert leaks.block_hashes(h[[3, 4]])[0] != leaks.block_hashes(h[[4, 3]])[0]


@pytest.mark.parametrize("every,length", [(3, 24), (4, 24), (6, 12), (2, 24)])
def test_stretches_with_regular_damage(every, length):
    rng = random.Random(every)
    found = 0
    for _ in range(100):
        words = [rng.choice(WORDS + RARE) for _ in range(40)]
        finder = leaks.Finder(leaks.build([" ".join(words)]))
        at = rng.randrange(40 - length)
        mine = words[at : at + length]
        for k in range(every - 1, length, every):
            j = rng.randrange(len(mine[k]))
            mine[k] = mine[k][:j] + rng.choice("qxz") + mine[k][j + 1 :]
        other = [rng.choice(OTHERS) for _ in range(10)]
        found += finder.found([finder.numbers([*other, *mine, *other])]) == [(0, 0)]
    assert found >= (99 if every > 2 else 0)


def test_advert_words_come_from_the_corpus(spark):
    docs = [(i, f"1\nriver letter {w}\n\n2\nVisit brandex{i % 2} at www.brandex.example and letter\n") for i, w in enumerate(WORDS)] + [(99, ""), (98, "no address here")]
    got = leaks.advert_words(spark.createDataFrame(docs, "id long, text string"))
    assert leaks._shapes("visit brandex brandex0 brandex1 example") <= got and not got & leaks._shapes("river letter")
    assert leaks.Spoken(got).words("Subs by team Brandex\nriver") == ["river"]
