"""op1 on personal data and look-alikes in forms that its fit does not share: recall and false spans of each kind."""

import random
from collections import Counter

from textmill.llm import pii

WORDS = "the of and market river stone garden winter people morning letter paper window number report table system public school answer little".split()
NAMES = "maria chen okafor smith dubois ivanov garcia kim".split()
LETTERS = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"


class Other:
    def __init__(self):
        self.r = random.Random(2024)

    def filler(self):
        return " ".join(self.r.choice(WORDS) for _ in range(6))

    def digits(self, *sizes, sep=""):
        return sep.join("".join(self.r.choice("0123456789") for _ in range(n)) for n in sizes)

    def card(self):
        body = "4" + self.digits(14)
        n = body + next(c for c in "0123456789" if pii.luhn(body + c))
        return self.r.choice([".", "  ", "/", " - "]).join(n[i : i + 4] for i in range(0, 16, 4))

    def planted(self, kind):
        r, d = self.r, self.digits
        return {
            "email": lambda: (r.choice(["write to ", "you can reach ", "- "]), f"{r.choice(NAMES)}.{r.choice(NAMES)}{r.choice([' at ', '(at)', ' [at] '])}{r.choice(['mail', 'inbox', 'corp'])}{r.choice([' dot ', '.', '[dot]', ' (dot) '])}{r.choice(['com', 'io', 'fr'])}"),
            "phone": lambda: (r.choice(["ring me on ", "mobile ", "tel ", "office phone: "]), r.choice([f"({d(3)}) {d(3, 4, sep=' ')}", d(3, 3, 4, sep="."), f"0{d(3, 6, sep=' ')}", d(3, 4, sep="-")])),
            "card": lambda: (r.choice(["charged to ", "visa ", "credit card no "]), self.card()),
            "national_id": lambda: (r.choice(["his ssn is ", "social security number ", "tax id: "]), d(3, 2, 4, sep="-")),
            "secret": lambda: (r.choice(["export API_KEY=", "password: ", "client secret = ", "token "]), "".join(r.choice(LETTERS) for _ in range(r.randint(18, 40))) + d(1)),
            "ip": lambda: (r.choice(["host ", "from server ", "ping "]), ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8))),
        }[kind]()

    def clean(self):
        r, d = self.r, self.digits
        return r.choice([
            f"in {r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"pages {r.randint(10, 99)}-{r.randint(100, 400)}", f"order {d(8)}", f"isbn {d(3, 1, 4, 4, 1, sep='-')}", f"version {d(1, 2, 2, sep='.')}",
            f"meet at {r.choice(WORDS)} on {r.choice(WORDS)}.", f"{r.choice(WORDS)}_{r.choice(WORDS)}_{d(2)}", f"population {d(1, 3, 3, sep=',')}", f"at {r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"the {r.choice(WORDS)}-{r.choice(WORDS)} {d(4)}",
        ])


def test_recall_and_false_spans_by_kind():
    d, other, recall = pii.train(), Other(), {}
    for kind in pii.KINDS:
        hits = 0
        for _ in range(200):
            cue, s = other.planted(kind)
            left = f"{other.filler()} {cue}"
            _, spans = pii.all_spans(f"{left}{s} {other.filler()}", d)
            hits += any(k == kind and a <= len(left) + 1 and b >= len(left) + len(s) - 1 for k, a, b in spans)
        recall[kind] = hits / 200
    assert min(recall.values()) >= 0.75 and sum(v >= 0.98 for v in recall.values()) >= 5, recall
    wrong = Counter()
    for _ in range(2000):
        base, spans = pii.all_spans(f"{other.filler()} {other.clean()} {other.filler()}", d)
        wrong.update(k for k, _, _ in set(spans) - set(base))
    # names joined by signs with digits, and book numbers that pass the checksum, are what it takes wrongly
    assert wrong["secret"] <= 0.06 * 2000 and wrong["card"] <= 0.02 * 2000 and not set(wrong) - {"secret", "card"}, wrong
