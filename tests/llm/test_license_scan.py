import random

import pytest

from leakwise.llm.license_scan import TEMPLATES, WIDTH, Scanner, license_scan, word_form
from leakwise.llm.licenses import PARAGRAPHS, read_templates


def brute(text, templates, threshold=0.8):
    """All windows of all templates by exact containment, overlapping ones merged."""
    words, out = text.split(), []
    shingles = lambda ws: {tuple(ws[i : i + WIDTH]) for i in range(len(ws) - WIDTH + 1)}
    for name, template in templates.items():
        form = [word_form(w) for w in template.encode().split()]
        want, n = shingles(form), len(form)
        run = []
        for at in [*range(len(words)), None]:
            part = [] if at is None else [word_form(w) for w in words[at : at + n]]
            share = len(want & shingles(part)) / len(want)
            if at is None or share >= threshold:
                if run and (at is None or at >= run[-1][0] + run[-1][1]):
                    best = max(run, key=lambda w: (w[2], -w[0]))
                    out.append((name, *best, len(run)))
                    run = []
                if at is not None:
                    run.append((at, len(part), share))
    return sorted(out)


def test_scan_finds_what_brute_force_finds():
    rng, texts = random.Random(4), []
    for _ in range(60):
        words = [rng.choice(["the", "license", "under", "x", "of", "foo"]) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            notice = rng.choice(list(TEMPLATES.values())).split()
            for _ in range(rng.randrange(3)):
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        texts.append(" ".join(words))
    texts += ["", TEMPLATES["mit-notice"].upper(), " ".join(TEMPLATES.values()) * 3]
    got = Scanner(TEMPLATES).scan([t.encode() for t in texts])
    assert [(i, *x) for i, t in enumerate(texts) for x in brute(t.encode(), TEMPLATES)] == got
    assert len(got) > 40


def test_bands_of_several_rows_keep_exact_copies():
    got = Scanner(TEMPLATES, bands=8, rows=3).scan([t.encode() for t in TEMPLATES.values()])
    assert {(i, name) for i, name, *_ in got} >= set(enumerate(TEMPLATES))


def test_recall_on_edited_copies():
    """Every licence paragraph is found where a run of its words was replaced, up to what leaves 0.8 of its shingles."""
    rng, scanner = random.Random(6), Scanner(TEMPLATES)
    texts, names = [], []
    for name, text in PARAGRAPHS.items():
        words = text.split()
        for _ in range(10):
            lost = max(0, (len(words) - WIDTH + 1) // 5 - 2 * WIDTH)
            edited = list(words)
            if lost:
                at = rng.randrange(len(words) - lost)
                edited[at : at + rng.randrange(1, lost + 1)] = ["changed"]
            around = ["other"] * rng.randrange(20)
            texts.append(" ".join([*around, *edited, *around]).encode())
            names.append(name)
    found = {(i, name) for i, name, *_ in scanner.scan(texts)}
    assert all((i, name) in found for i, name in enumerate(names))


def test_templates_from_files(spark, tmp_path):
    (tmp_path / "own.txt").write_text("Title\n\n" + "one two three four five six seven eight\nnine ten eleven twelve\n\n1.\n")
    found = read_templates(spark, str(tmp_path))
    assert found == {"own-1": "one two three four five six seven eight nine ten eleven twelve"}
    frame = spark.createDataFrame([(1, "x one two three four five six seven eight nine ten eleven twelve")], "doc_id long, text string")
    assert [r.first_word for r in license_scan(frame, found).collect()] == [1]


def test_frame_cases(spark):
    shape = "doc_id long, text string, template string, windows long"
    mit = TEMPLATES["mit-notice"]
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, "a b " * 40_000 + mit), (4, "no licence here at all")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], shape)
    got = sorted(((r.doc_id or 0, r.template, r.first_word) for r in license_scan(frame).collect()))
    assert got == [(0, "mit-notice", 80_000), (3, "mit-notice", 0), (3, "mit-notice", 0)]
    assert license_scan(frame.limit(0)).count() == 0 and license_scan(frame, templates={}).count() == 0
    with pytest.raises(ValueError):
        Scanner({"short": "one two three"})
