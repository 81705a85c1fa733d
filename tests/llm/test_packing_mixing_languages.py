import random
from collections import Counter, defaultdict

import pytest

from lodeline.llm import langid, mixing, packing
from lodeline.llm.tokens import count

SIZES = "doc_id long, tokens long, curve long"


def test_hilbert_curve_visits_every_cell_once_and_steps_to_a_neighbour():
    cells = sorted((packing.hilbert_key([x, y, z], 3), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [k for k, _ in cells] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(cells, cells[1:]))


def test_packing_keeps_everything_and_splits_only_what_must_be(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([rnd.randrange(1, 60), rnd.randrange(60, 500), 3000]), rnd.randrange(1 << 20)) for i in range(3000)]
    kinds = spark.createDataFrame([("a", 500, 0), ("b", 130, 2), ("c", 5000, None)], "container_name string, capacity_tokens int, reserved_tokens int")
    rows = packing.pack_documents(spark.createDataFrame(sizes, SIZES), kinds).collect()
    room = {"a": 500, "b": 128, "c": 5000}
    used, got, pieces = Counter(), Counter(), defaultdict(list)
    for r in rows:
        used[r["container_name"], r["container_no"]] += r["tokens"]
        got[r["container_name"], r["doc_id"]] += r["tokens"]
        pieces[r["container_name"], r["doc_id"]].append((r["piece_no"], r["tokens"]))
    assert all(n <= room[k] for (k, _), n in used.items())
    for doc, n, _ in sizes:
        for k in room:
            assert got[k, doc] == n
            parts = [t for _, t in sorted(pieces[k, doc])]
            assert len(parts) == -(-n // room[k]) and all(t == room[k] for t in parts[:-1])
    total = sum(n for _, n, _ in sizes)
    for k in ("a", "b"):
        assert total / (sum(1 for c, _ in used if c == k) * room[k]) > 0.97
    fill = {r["container_name"]: r for r in packing.fill_report(packing.pack_documents(spark.createDataFrame(sizes, SIZES), kinds), kinds).collect()}
    assert fill["a"]["documents"] == 3000 and fill["a"]["tokens"] == total


def test_packing_edges(spark):
    kinds = spark.createDataFrame([("a", 10, 10)], "container_name string, capacity_tokens int, reserved_tokens int")
    empty = spark.createDataFrame([], SIZES)
    with pytest.raises(ValueError):
        packing.pack_documents(empty, kinds)
    kinds = spark.createDataFrame([("a", 10, 0)], "container_name string, capacity_tokens int, reserved_tokens int")
    assert packing.pack_documents(empty, kinds).count() == 0
    docs = spark.createDataFrame([(1, "some words here", "x"), (2, None, "x"), (3, "", "x"), (None, "words", "x"), (4, "!!!", "x")], "doc_id long, text string, tokens string")
    got = {r["doc_id"]: r["tokens"] for r in packing.measured(docs).collect()}
    assert got == {1: count("some words here"), 4: count("!!!")}


def test_sainte_lague_against_dealing_one_by_one():
    rnd = random.Random(2)
    for _ in range(40):
        shares = {f"s{i}": rnd.choice([0.0, rnd.random(), 0.25]) for i in range(6)}
        seats = rnd.randrange(200)
        want = dict.fromkeys(shares, 0)
        for _ in range(seats if any(shares.values()) else 0):
            best = min((k for k in shares if shares[k] > 0), key=lambda k: (-shares[k] / (2 * want[k] + 1), k))
            want[best] += 1
        assert mixing.sainte_lague(shares, seats) == want
    ends = mixing.quotas({"a": 0.7, "b": 0.3}, 1001, 7)
    assert all(x <= y for v in ends.values() for x, y in zip(v, v[1:])) and sum(v[-1] for v in ends.values()) == 1001
    assert sum(mixing.sainte_lague({"a": 0.9, "b": 0.1}, 3_000_000_000).values()) == 3_000_000_000


def test_mix_meets_shares_within_repeats(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["big"] * 8 + ["mid", "small", "other", None]), rnd.randrange(20, 400)) for i in range(4000)] + [(9000, "small", 90_000)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, tokens long").where("source in ('big', 'mid', 'small')")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 2), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets).cache()
    report = {r["source"]: r for r in mixing.share_report(mixed, targets).collect()}
    assert all(abs(report[s]["actual_share"] - w) < 0.005 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2))), report
    uses = Counter((r["source"], r["doc_id"]) for r in mixed.collect())
    assert all(n <= {"big": 1, "mid": 3, "small": 2}[s] for (s, _), n in uses.items())
    assert len({(r["doc_id"], r["pass_no"]) for r in mixed.collect()}) == mixed.count()
    assert sorted(map(tuple, mixing.mix(sizes, targets).collect())) == sorted(map(tuple, mixed.collect()))
    assert mixing.mix(sizes.limit(0), targets).count() == 0


TEXT = {
    "en": ["The team wants to read the report before the next meeting.", "Nobody knows where the old files were kept after the move.", "We have to write the answer again because it was lost.", "There is no reason to change the plan this week."],
    "de": ["Das Team will den Bericht vor der nächsten Sitzung lesen.", "Niemand weiß, wo die alten Dateien nach dem Umzug liegen.", "Wir müssen die Antwort noch einmal schreiben, weil sie verloren ging.", "Es gibt keinen Grund, den Plan diese Woche zu ändern."],
    "fr": ["L'équipe veut lire le rapport avant la prochaine réunion.", "Personne ne sait où les anciens fichiers sont rangés.", "Nous devons écrire la réponse encore une fois, car elle est perdue.", "Il n'y a aucune raison de changer le plan cette semaine."],
}


def test_automaton_accepts_exactly_substrings():
    text = "abcabxabcd"
    machine = langid.Automaton(text)
    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    rnd = random.Random(4)
    for _ in range(500):
        s = "".join(rnd.choice("abcdx") for _ in range(rnd.randrange(1, 6)))
        assert (machine.phrases(s) == 1) == (s in subs)

    def greedy(s):
        n = i = 0
        while i < len(s):
            j = i + 1
            while j <= len(s) and s[i:j] in subs:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    for _ in range(300):
        s = "".join(rnd.choice("abcdxz") for _ in range(30))
        assert machine.phrases(s) == greedy(s)


def test_labels():
    assert [langid.label_language(x) for x in ("EN", " de", "pt-BR", "Español", "jpn", "en_GB", "und", "??", "", None, "n/a", "xx")] == ["en", "de", "pt", "es", "ja", "en", None, None, None, None, None, None]


def test_segments_and_cases(spark):
    rnd = random.Random(5)
    docs, i = [], 0
    for code, lines in TEXT.items():
        for _ in range(30):
            docs.append((i, "\n".join(rnd.sample(lines, 3)), code if rnd.random() < 0.9 else "fr", "x"))
            i += 1
    mixed = "```\ncode here\n```\n" + TEXT["en"][0] + "\n\n| 1 | 2 |\n" + TEXT["de"][1] + "\n> " + TEXT["de"][2] + "\nhttps://x.example/y\n" + TEXT["en"][1]
    docs += [(900, mixed, "en", "x"), (901, None, "en", "x"), (902, "", "en", "x"), (903, "    a = b(1);\n| 1 |", None, "x"), (904, TEXT["fr"][0].upper(), "French", "x"), (905, TEXT["de"][0] + ' "' + TEXT["en"][0] + '"', "de", "x"), (906, TEXT["en"][0], None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, segments string")
    got = defaultdict(list)
    for r in langid.segments(df).orderBy("doc_id", "segment_no").collect():
        got[r["doc_id"]].append((r["segment_no"], r["lang"], r["lines"], r["label_right"]))
        assert 0 <= r["confidence"] <= 1
    assert [x[:3] for x in got[900]] == [(1, "en", 3), (2, "de", 3), (3, "en", 1)] and not got[900][0][3]
    assert not (got[901] or got[902] or got[903])
    assert got[904] == [(1, "fr", 1, True)] and got[905] == [(1, "de", 1, True)] and got[906] == [(1, "en", 1, False)]
    assert langid.segments(df.limit(0)).count() == 0
