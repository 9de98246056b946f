import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

EXTRA = "key long, h long, n long, row long, id long, name string, place long, doc long, keep_id long, `group` long, `order` long, pos long, kept_text string"


def messy_rows(seed=7):
    rnd = random.Random(seed)
    vocab = ["the", "of", "Über", "naïve", "x.", "a", "a'll", "Été", "end.", *[f"w{i}" for i in range(60)], *[f"V{i}q" for i in range(400)]]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, longer = text(58), text(140)
    base = text(120)
    rows = []
    for i in range(30):
        rows.append((i, text(rnd.randint(1, 160))))
    for i in range(30, 50):
        w = base.split()
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(50, 64):
        rows.append((i, f"{text(rnd.randint(0, 40))}\n{passage}  {text(rnd.randint(0, 40))}"))
    for i in range(64, 72):
        a, b = sorted((rnd.randint(0, 60), rnd.randint(70, 140)))
        rows.append((i, " ".join([text(5), *longer.split()[a:b], text(9)])))
    rows += [(72, None), (73, ""), (74, " \t\n\r\x0b\x0c "), (75, "One"), (76, "one"), (77, "Two words"), (78, "!!! 123 ..."), (79, "a " * 300)]
    rows += [(80, rows[3][1]), (81, rows[3][1]), (90, rows[31][1]), (91, rows[31][1] + " more"), (90, rows[31][1]), (92, rows[5][1]), (92, rows[50][1])]
    rows += [(None, rows[3][1]), (None, text(70)), (None, None), (93, text(9000)), (-5, passage), (10**12, base), (94, "café café   <|endoftext|>x \U0001f600‍ \x00 \x1c\x85 İΣ")]
    rows += [(95, "p one.\np two.\np one."), (96, "p two.\np one.\np one."), (97, "z" * 3000), (98, "word " * 60 + "tail"), (99, "word " * 70 + "tail")]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return messy_rows()


@pytest.fixture(scope="session")
def messy(spark, rows):
    """Documents with nulls, repeats and ties, and further columns whose names operators use."""
    langs = ["en", None, "de", ""]
    data = [(i, t, langs[n % 4], None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t), *[n] * 5, None, *[n] * 6, "k") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(5, "n").cache()


@pytest.fixture(scope="session")
def empty(messy):
    return messy.limit(0)


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got, want = sorted(map(tuple, got), key=key), sorted(map(tuple, want), key=key)
    assert got == want


@pytest.fixture(scope="session")
def equal():
    return same
