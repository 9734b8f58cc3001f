import random

import pytest

from spanforge.llm import license_scan


def least_edits(words, want, held, most):
    """The fewest words that differ between ``want`` and any run of ``words``, tried one by
    one: no held word missing or changed, nothing between held neighbours; None beyond ``most``."""
    best = None
    for start in range(len(words)):
        row = [0] + [None] * len(want)  # row[i]: edits after i wanted words; the run begins here
        for i, h in enumerate(held):
            row[i + 1] = None if h or row[i] is None else row[i] + 1
        for at in range(start, min(len(words), start + len(want) + most)):
            new = [None] * (len(want) + 1)
            for i in range(len(want) + 1):
                ways = []
                if row[i] is not None and 0 < i < len(want) and not (held[i - 1] and held[i]):
                    ways.append(row[i] + 1)  # a word more
                if i and row[i - 1] is not None and words[at] == want[i - 1]:
                    ways.append(row[i - 1])
                if i and row[i - 1] is not None and not held[i - 1]:
                    ways.append(row[i - 1] + 1)  # another word
                if i and new[i - 1] is not None and not held[i - 1]:
                    ways.append(new[i - 1] + 1)  # a word missing
                new[i] = min(ways) if ways else None
            row = new
            if row[-1] is not None and row[-1] <= most and (best is None or row[-1] < best):
                best = row[-1]
    return best


@pytest.mark.parametrize("seed", range(6))
def test_stretches_equal_a_scan_of_all_word_windows(seed):
    draw = random.Random(seed)
    scan = license_scan.Scanner()
    short = [t for t, w in enumerate(scan.words) if len(w) <= 30]
    assert len(short) >= 12
    pool = sorted({w for t in short for w in scan.words[t]})
    words = [draw.choice(pool) for _ in range(15)]
    for t in draw.sample(short, 3):
        notice = list(scan.words[t])
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(notice))
            kind = draw.choice(["drop", "change", "add"])
            notice[k : k + (kind != "add")] = [] if kind == "drop" else [draw.choice(pool)]
        words += notice + [draw.choice(pool) for _ in range(draw.randint(0, 4))]
    places = {}
    for i, w in enumerate(words):
        places.setdefault(w, []).append(i)
    for t in short:
        found = [wrong for _, _, wrong in scan.stretches(words, places, t)]
        most = int(scan.tolerance * len(scan.words[t]))
        assert min(found, default=None) == least_edits(words, scan.words[t], scan.held[t], most), scan.names[t]
