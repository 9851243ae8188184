"""The gate of disguised words beside its definition, one match object per atom."""

import random
import time

from corvane.llm import toxicity as T

WORDS = "stupid idiot lazy moron scum worthless".split()


def plain(gate, text):
    atoms, i, out = list(T._ATOM.finditer(text)), 0, []
    while i < len(atoms):
        whole, end = T.fold(atoms[i].group()), 0
        if whole in gate.starts:
            for j in range(i, min(i + T.PARTS, len(atoms))):
                if j > i:
                    gap = text[atoms[j - 1].end() : atoms[j].start()]
                    if len(gap) > 2 or gap.strip(T.SEPARATORS):
                        break
                    nxt = T.fold(atoms[j].group())
                    whole = whole + (nxt[1:] if nxt[:1] == whole[-1:] else nxt)
                    if whole not in gate.starts:
                        break
                if whole in gate.folded:
                    end = j + 1
        if end and not (end == i + 1 and atoms[i].group().lower() in gate.plain):
            out.append((atoms[i].start(), atoms[end - 1].end()))
        i = max(end, i + 1)
    return out


def texts(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        t = r.choices([*WORDS, "st", "upid", "i d i o t", "id10t", "l@@zy", "sc. um", "mor--on", "m0r0n", "st   upid", "woorthless", "x", "the", "é", "s", "aaa"], k=r.randrange(12))
        yield "".join(w + r.choice(["", " ", ". ", "-", "\n", ", ", "  ", "*"]) for w in t)


def test_spans_are_those_of_the_definition():
    gate, found = T.Gate(WORDS), 0
    for t in ["", " ", "stupid", *texts(4000, 1)]:
        want = plain(gate, t)
        assert list(gate.spans(t)) == want
        found += len(want)
    assert found > 1000
    assert not list(T.Gate([]).spans("st upid"))


def test_suspects_without_a_run_are_found_by_the_shorter_pattern():
    for t in texts(4000, 2):
        if not any(x in t for x in T._TRIPLES):
            assert [m.span() for m in T._SUSPECT.finditer(t)] == [m.span() for m in T._SUSPECT_MIXED.finditer(t)]
    assert T.restore("that stuuupid l4zy m o r o n", T.Decoder(T.np.ones((T.SYMBOLS,) * 3)), T.Gate(WORDS)) != ""


def test_plain_text_costs_less_than_a_match_object_per_atom():
    gate = T.Gate(WORDS)
    text = "plain words of the sort that most texts are made of " * 400
    gate.known.update({w: T.fold(w) for w in text.split()})

    def least(f):
        took = []
        for _ in range(7):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    def old():
        atoms = list(T._ATOM.finditer(text))
        return [gate._folded(a.group()) in gate.starts for a in atoms]

    assert least(lambda: list(gate.spans(text))) < 0.8 * least(old)
