import random


def prose(seed: int, words: int) -> str:
    """Invented words, a full stop and a line break now and then."""
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
        out.append(w + (".\n" if i % 17 == 16 else " "))
    return "".join(out).strip()
