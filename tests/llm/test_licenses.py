import random
from itertools import product

from sparkcurves.llm import licenses as L

SCHEMA = "doc_id long, text string"


def test_every_template_has_a_telling_word():
    telling = set(L.telling_words(L.TEMPLATES))
    for text in L.TEMPLATES.values():
        assert telling & set(L.words(text))


def test_differences_against_all_alignments():
    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            previous, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
        return row[-1]

    for a, b in product(["a b c", "x a b c y", "a q c", "", "a b b c", "c b a"], ["a b c", "b", "a c"]):
        a, b = a.split(), b.split()
        want = min(edit(b, a[i:j]) for i in range(len(a) + 1) for j in range(i, len(a) + 1))
        assert sum(L.differences(a, b)) == want
    assert sum(L.differences("copyright c 2020 acme".split(), ["copyright", "c", "<year>", "<owner>"])) == 0


def test_notices_are_found_in_lines_of_any_length(spark):
    filler = " ".join(f"word{i}" for i in range(3000))
    rows = [(1, "Some text\nReleased under the MIT License.\nmore"), (2, "licensed under the apache license, version 2.0"), (3, "no notice here"), (4, None),
            (5, ""), (None, "All rights reserved."), (6, f"{filler} Licensed under CC BY-NC 4.0. {filler}"), (7, "This work is licensed under the GNU General Public License, version 2."),
            (8, "der Mann fuhr mit dem Zug"), (9, "Copyright (c) 2021 Jane Doe. All rights reserved."), (1, "Released under the MIT License.")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", line string")
    got = L.scan(frame).collect()
    found = sorted((r["doc_id"] or 0, r["line"], r["license"]) for r in got if r["confirmed"])
    assert found == [(0, 0, "all-rights-reserved"), (1, 0, "MIT"), (1, 1, "MIT"), (2, 0, "Apache-2.0"), (6, 0, "CC-BY-NC-4.0"), (7, 0, "GPL-3.0"), (9, 0, "copyright")]
    near = next(r for r in got if r["doc_id"] == 7)
    assert (near["missing"], near["added"], near["replaced"]) == (0, 0, 1)
    assert all(r["doc_id"] not in (3, 4, 5) for r in got) and all(r["bytes_given"] < r["bytes_alone"] for r in got if r["confirmed"])


def test_own_templates_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "Property of Foo Industries, do not share")], SCHEMA)
    assert [r["license"] for r in L.scan(docs, {"foo": "Property of Foo Industries, do not share."}).collect() if r["confirmed"]] == ["foo"]
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def confirmed(spark, rows):
    got = L.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r["doc_id"], r["line"], r["license"]) for r in got if r["confirmed"])


def wrapped(text, width, mark):
    own = text.split()
    return "\n".join(mark + " ".join(own[i : i + width]) for i in range(0, len(own), width))


def test_notices_wrapped_over_lines(spark):
    names = sorted(name for name, text in L.TEMPLATES.items() if "<" not in text)
    rows = [(i, "int x;\nint y;\n" + wrapped(L.TEMPLATES[name], width, mark) + "\nint z;")
            for i, (name, (width, mark)) in enumerate(product(names, [(12, " * "), (5, "// "), (2, "# "), (12, "REM ")]))]
    want = [(i, 2, name) for i, (name, _) in enumerate(product(names, range(4)))]
    assert confirmed(spark, rows) == want


def test_all_notices_of_a_line(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0"]
    filler = " ".join(f"word{i}" for i in range(20))
    rows = [(1, f"{apache} All rights reserved."), (2, f"x\n{mit} {apache}"), (3, f"{mit} {filler} {mit} {filler} {apache} {filler} {mit}"), (4, f"{mit}\n{mit}"),
            (5, f"Copyright (c) 2020 Jane Doe. {mit} All rights reserved."), (6, L.TEMPLATES["Apache-2.0-header"])]
    assert confirmed(spark, rows) == [(1, 0, "Apache-2.0"), (1, 0, "all-rights-reserved"), (2, 1, "Apache-2.0"), (2, 1, "MIT"), (3, 0, "Apache-2.0"), (3, 0, "MIT"),
                                      (3, 0, "MIT"), (3, 0, "MIT"), (4, 0, "MIT"), (4, 1, "MIT"), (5, 0, "MIT"), (5, 0, "copyright"), (6, 0, "Apache-2.0-header")]


CHOSEN = tuple(sorted(L.TEMPLATES.items()))


def odd_text(rng):
    """Notices with some words changed, between other words that are partly the templates' own."""
    telling = [w for text in L.TEMPLATES.values() for w in text.split()] + [f"word{i}" for i in range(60)]
    out = []
    for _ in range(rng.randrange(1, 6)):
        out += rng.choices(telling, k=rng.randrange(0, 90))
        own = rng.choice(list(L.TEMPLATES.values())).replace("<year> <owner>", "2020 Jane Doe").split()
        for i in range(len(own)):
            if rng.random() < 0.08:
                own[i] = rng.choice(telling)
        out += own
    return "\n".join(" ".join(out[i : i + 11]) for i in range(0, len(out), 11))


def test_ranked_candidates_lose_no_notice(monkeypatch):
    rng = random.Random(5)
    texts = [odd_text(rng).split("\n") for _ in range(150)]
    run = lambda: [L.notices(lines, list(range(len(lines))), CHOSEN, 9, 0.2, 6) for lines in texts]
    got = run()
    monkeypatch.setattr(L, "candidates", lambda window, templates, level: list(range(len(templates))))  # every template against every window
    assert got == run() and sum(map(len, got)) > 300


def test_compression_chooses_the_candidates(monkeypatch):
    lines = ["Some words before it.", L.TEMPLATES["MIT"], "and after."]
    own = L.words(" ".join(lines))
    assert L.candidates(own, CHOSEN, 9)[0] == [name for name, _ in CHOSEN].index("MIT")
    assert L.candidates("river stone winter light".split(), CHOSEN, 9) == []
    assert [n[2] for n in L.notices(lines, [1], CHOSEN, 9, 0.2, 6)] == ["MIT"]
    swapped = tuple((name, "river stone winter light") for name, _ in CHOSEN)
    dictionaries = L._word_compressors
    monkeypatch.setattr(L, "_word_compressors", lambda templates, level: dictionaries(swapped, level))
    assert L.notices(lines, [1], CHOSEN, 9, 0.2, 6) == []
