import random

import numpy as np
import pytest

from tidemark.llm import licenses

INDEX = licenses.Index(licenses.TEMPLATES)


def plain_best(template, text):
    """Smith-Waterman over the whole table: best score."""
    best, row = 0, [0] * (len(text) + 1)
    for w in template:
        new = [0]
        for j, x in enumerate(text):
            new.append(max(0, row[j] + (1 if w == x else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(5))
def test_alignment_against_the_whole_table(seed):
    rng = random.Random(seed)
    for _ in range(40):
        template = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        text = [None] * rng.randint(0, 5) + [rng.randrange(6) if rng.random() < 0.2 else w for w in template if rng.random() < 0.9] + [None] * 3
        got = licenses.align(template, text, 3, 60)
        assert (got[0] if got else 0) == plain_best(template, text)
        if got:
            assert 0 <= got[2] < got[3] <= len(text) and got[1] <= min(len(template), got[3] - got[2])


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_template_in_noise(name):
    rng = random.Random(name)
    noise = lambda: " ".join("".join(rng.choices("xqzvkj", k=6)) for _ in range(50))
    before, notice = "Ünï — " + noise(), licenses.TEMPLATES[name]
    text = f"{before}\n{notice.upper()}\n{noise()}"
    found = licenses.scan(text, INDEX)
    assert [(f["license"], f["coverage"]) for f in found] == [(name, 1.0)]
    assert text[found[0]["start"] : found[0]["stop"]].lower() in notice.lower()
    # a few words changed, left out and put in
    edited = notice.split()
    if len(edited) > 20:
        edited[5], edited[9:10], edited[14] = "changed", [], "put in"
        found = licenses.scan(f"{before} {' '.join(edited)} {noise()}", INDEX)
        assert found[0]["license"] == name and 0.8 < found[0]["coverage"] < 1


@pytest.mark.parametrize("extra", [9, 20, 60])
@pytest.mark.parametrize("name", ["MIT", "BSD", "Apache-2.0", "GPL-3.0", "ISC"])
def test_words_put_into_the_middle(name, extra):
    rng = random.Random(f"{name} {extra}")
    put_in = lambda n: " ".join("".join(rng.choices("xqzvkj", k=6)) for _ in range(n))
    notice = licenses.TEMPLATES[name].split()
    extra = min(extra, len(notice) - 2)
    middle = len(notice) // 2
    split = " ".join([*notice[:middle], put_in(extra), *notice[middle:]])
    text = f"{put_in(30)} {split} {put_in(30)}"
    assert [(f["license"], f["coverage"]) for f in licenses.scan(text, INDEX)] == [(name, 1.0)]
    # two places, and a second copy
    third = len(notice) // 3
    split = " ".join([*notice[:third], put_in(extra), *notice[third : 2 * third], put_in(extra), *notice[2 * third :]])
    found = licenses.scan(f"{split} {put_in(5)} {split}", INDEX)
    assert [(f["license"], f["coverage"]) for f in found] == [(name, 1.0)] * 2


def test_families_and_whole_texts():
    found = lambda text: [(f["license"], f["start"], f["stop"]) for f in licenses.scan(text, INDEX)]
    gpl = licenses.TEMPLATES["GPL-2.0"]
    lesser = gpl.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of")
    affero = licenses.TEMPLATES["GPL-3.0"].replace("GNU General", "GNU Affero General")
    assert found(lesser) == [("LGPL-2.1", 0, len(lesser) - 1)] and found(affero) == [("AGPL-3.0", 0, len(affero) - 1)]
    assert [f[0] for f in found(gpl)] == ["GPL-2.0"] and [f[0] for f in found(licenses.TEMPLATES["GPL-3.0"])] == ["GPL-3.0"]
    eclipse = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"
    assert [f[0] for f in found(eclipse)] == ["EPL-2.0"]
    # the regents' text, whose third clause and disclaimer name others
    regents = licenses.TEMPLATES["BSD-3-Clause full"].replace("the copyright holder nor", "the University nor").replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    assert found(regents) == [("BSD-3-Clause full", 0, len(regents) - 1)]
    assert [f[0] for f in found(licenses.TEMPLATES["BSD-2-Clause full"])] == ["BSD-2-Clause full"]
    for name, end in (("MIT full", "SOFTWARE."), ("ISC full", "SOFTWARE.")):
        text = licenses.TEMPLATES[name]
        assert text.endswith(end) and found(f"Copyright 2020 A. Holder\n\n{text}") == [(name, 26, 25 + len(text))]


def test_winnowing_keeps_one_of_each_window():
    rng = random.Random(1)
    hashes = [rng.randrange(50) for _ in range(300)]
    kept = licenses.winnow(hashes, 4)
    assert all(any(j in kept for j in range(i, i + 4)) for i in range(297)) and len(kept) < 200


def test_columns(spark):
    notice = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "clean words of a text"), (4, f"a {notice} b {notice} c"), (5, notice), (5, notice), (6, "İ" * 3 + " " + notice), (7, "the software is under the terms of the license " * 2000), (None, notice)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, license string")
    out = licenses.with_licenses(docs).collect()
    got = [(r.doc_id, [(f.license, f.start, f.stop) for f in r.licenses]) for r in out]
    one = [("MIT notice", 0, 30)]
    assert [g for g in got if g[0] != 7] == [(1, []), (2, []), (3, []), (4, [("MIT notice", 2, 32), ("MIT notice", 36, 66)]), (5, one), (5, one), (6, [("MIT notice", 4, 34)]), (None, one)]
    assert licenses.with_licenses(docs.limit(0)).collect() == []


def plain_score(template, text):
    """Smith-Waterman over the whole table, a row at a time: best score."""
    text, best = np.array([-1 if x is None else x for x in text]), 0
    row, steps = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for w in template:
        new = np.maximum(0, row - 1)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, 1, -1))
        row = np.maximum.accumulate(new + steps) - steps  # gaps in the template
        best = max(best, int(row.max()))
    return best


def test_query_against_every_template(spark, tmp_path):
    """The query over a table of texts, against full alignments of all templates with all texts.

    Wherever a full alignment scores 0.6 of a template or more, the query
    reports that template or one that scores no less; what it reports does score.
    """
    from tidemark.llm.queries import QUERIES

    rng = random.Random(21)
    noise = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    short = [n for n, t in licenses.TEMPLATES.items() if len(licenses.words(t)) < 260]
    rows = [None, "", noise(60), "the and of this is to be in software " * 10]
    for name in short:
        own = licenses.TEMPLATES[name].split()
        for _ in range(len(own) // 12):  # some words go, some are changed
            at = rng.randrange(len(own))
            own[at] = rng.choice(["", "changed", own[at]])
        rows.append(f"{noise(20)} {' '.join(own)} {noise(20)}")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in QUERIES["op8_licenses"](spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(range(len(rows)))
    for i, text in enumerate(rows):
        numbers = list(map(INDEX.vocabulary.get, licenses.words(text or "")))
        scores = {n: plain_score(t, numbers) for n, t in zip(INDEX.names, INDEX.templates, strict=True)} if numbers else {}
        told = [r.license for r in found[i] if r.license is not None]
        assert all(scores[n] > 0 for n in told) and found[i][0].n_licenses == len(told)
        due = [s for n, s in scores.items() if s >= 0.6 * len(INDEX.templates[INDEX.names.index(n)])]
        if due:
            assert told and max(scores[n] for n in told) >= max(due) - 8, (i, told)
        for r in found[i]:
            if r.license is not None:
                assert r.coverage >= 0.6 and 0 <= r.start < r.stop <= len(text)
    assert not [r for i in range(4) for r in found[i] if r.license is not None]


def dense(template: list[int], text: list[int | None], start: int, band: int) -> tuple[int, int, int, int, int, int] | None:
    """Every cell of the band: the best local alignment of a template around one diagonal: (score, matched words, first, end) in the text, (first, end) in the template.

    ``start`` is where the template's first word falls in the text; an
    alignment may stray ``band`` words from that diagonal. A match scores 1, a
    mismatch or a gap -1. Equal scores go to the one that ends first.
    """
    width = 2 * band + 1
    score, matched, begun = [0] * width, [0] * width, [(0, 0)] * width
    best = (0, 0, 0, 0, 0, 0)
    for i, word in enumerate(template):
        new_score, new_matched, new_begun = [0] * width, [0] * width, [(0, 0)] * width
        for c in range(width):
            j = start + i + c - band
            if not 0 <= j < len(text):
                continue
            same = text[j] == word
            options = [(score[c] + (1 if same else -1), matched[c] + same, begun[c] if score[c] > 0 else (j, i))]
            if c + 1 < width:
                options.append((score[c + 1] - 1, matched[c + 1], begun[c + 1]))
            if c:
                options.append((new_score[c - 1] - 1, new_matched[c - 1], new_begun[c - 1]))
            top = max(options, key=lambda o: (o[0], o[1]))
            if top[0] > 0:
                new_score[c], new_matched[c], new_begun[c] = top
                if top[0] > best[0]:
                    best = (top[0], top[1], top[2][0], j + 1, top[2][1], i + 1)
        score, matched, begun = new_score, new_matched, new_begun
    return best if best[0] else None



def test_alignment_against_every_cell():
    rng = random.Random(5)
    for _ in range(400):
        size, band = rng.choice([3, 8, 40]), rng.choice([1, 2, 5])
        template = [rng.randrange(size) for _ in range(rng.randint(1, 40))]
        text = [x for w in template for x in rng.choice([[w], [w], [w], [], [w, rng.randrange(size)], [None]])] if rng.random() < 0.6 else [rng.choice([None, *range(size)]) for _ in range(rng.randint(0, 50))]
        text = [None] * rng.randint(0, 3) + text
        start = rng.randint(-5, 8)
        assert licenses.align(template, text, start, band) == dense(template, text, start, band)


def test_a_whole_long_license_takes_little_time():
    import time

    index = licenses.Index(licenses.TEMPLATES)
    text = max(licenses.TEMPLATES.values(), key=len)
    began = time.process_time()
    found = licenses.scan("Some words before. " + text, index)
    assert len(found) >= 1 and time.process_time() - began < 8


def test_templates_are_found_in_an_archive(tmp_path):
    import subprocess
    import sys

    from tidemark import ship

    at = ship.archive(tmp_path / "tidemark.zip")
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(at)!r}); from tidemark.llm import licenses; print(licenses.__file__, len(licenses.TEMPLATES))"], cwd=tmp_path, capture_output=True, text=True)
    assert "tidemark.zip" in run.stdout and run.stdout.split()[-1] == str(len(licenses.TEMPLATES)), run.stderr[-500:]
