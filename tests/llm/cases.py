"""Small hostile texts, and plain Python versions of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1):
    """Unique, copied, nearly copied and overlapping texts; nulls, empties, repeated rows, one long text."""
    rng = random.Random(seed)
    shared = prose("shared", 70)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "One TWO"), (None, " ".join(shared)), (5, "a b c d e")]
    for i in range(10, 40):
        own = prose((seed, i).__repr__(), rng.randrange(5, 260))
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = shared[rng.randrange(0, 15) : rng.randrange(55, 71)]
        out.append((i, " ".join(own)))
        if i % 4 == 0:
            near = list(own)
            for _ in range(max(1, len(near) // 60)):
                near[rng.randrange(len(near))] = "changed"
            out.append((100 + i, "\n".join(near)))
        if i % 5 == 0:
            out.append((200 + i, "  ".join(own).upper() if i % 2 else " ".join(own)))
    out.append((300, " ".join(shared * 200)))
    out.append((12, dict(out)[12]))
    out.append((13, " ".join(shared)))
    return out
