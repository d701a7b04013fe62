"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

VOWELS, CONSONANTS = "aeiou", "bcdfghlmnprst"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    word = lambda: "".join(r.choice(CONSONANTS) + r.choice(VOWELS) for _ in range(r.randint(1, 4)))
    words = [word() for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += ".\n" if i % 20 == 9 else "."
    return " ".join(words)


BASE = prose(1, 300)
ITEM = prose(77, 30)
LINE = "Subscribe to the letter of this site today."


def rows():
    texts = [BASE, BASE, BASE.replace("a", "A"), None, "", "   \n\t ", "word", "a b c", "x" * 30_000, prose(2, 4000), prose(3, 200) + "\n" + LINE]
    texts += [prose(i, 120) + "\n" + LINE for i in range(10, 20)]
    texts += [prose(4, 60) + " " + ITEM + " " + prose(5, 60), "Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of Of", prose(6, 100) + "\n" + "\n".join([prose(7, 10)] * 6)]
    texts += ["ÉTÉ 日本語 \U0001f642 naïve", "call (212) 555-1234", prose(8, 50) + " juan.soto@mail3.example.com and +1 (415) 555-0199 or 10.20.30.40"]
    langs = ["en", None, "fr"]
    out = [(i, t, langs[i % 3] if i != 3 else None, None if i == 5 else f"src{i % 2 if t and LINE not in t else 0}", len(t or "")) for i, t in enumerate(texts)]
    out.append(out[0])  # a repeated row
    out.append((None, prose(9, 80), "en", None, 1))
    return out


def conversations():
    """Turns with nulls everywhere, ties, repeated rows, copies, shared beginnings, a long and a blank conversation."""
    r = random.Random(5)
    out = []
    for c in range(0, 130):
        if c % 20 == 0 and c % 40:
            continue  # their followers have nothing to begin with
        kind = c % 7
        n = r.choice([1, 2, 3, 3, 5, 9]) if c != 63 else 60
        for t in range(n):
            text = f"say {r.randint(0, 2)}" if kind < 3 else f"line {t}" if kind < 5 else r.choice(["", None, "a b c", "é 日本"])
            out.append((c, r.choice([t, t, t, 0, None]), r.choice(["user", "user", None]), text))
    out += [out[0], out[5], (None, 0, "user", "nobody"), (7001, None, None, None)]
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory):
    """documents (with extra columns named like inner ones), benchmark and labels."""
    d = tmp_path_factory.mktemp("sf")
    data = rows()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    columns = {n: pa.array([r[i] for r in data], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}
    for extra in ("kept", "score", "shard", "id", "n", "h", "row", "key", "node", "component_id", "lower"):
        columns[extra] = pa.array(["x"] * len(data))
    pq.write_table(pa.table(columns), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2, 3, 4], pa.int64()), "text": pa.array([ITEM, None, "", "..."])}), d / "benchmark.parquet")
    labels = [(r[0], 0 if "Of Of" in (r[1] or "") else 1) for r in data] + [(999, 1), (2, None)]
    pq.write_table(pa.table({"doc_id": pa.array([a for a, _ in labels], pa.int64()), "quality": pa.array([b for _, b in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), d / "labels.parquet")
    talks = conversations()
    columns = {n: pa.array([r[i] for r in talks], k) for i, (n, k) in enumerate(zip(["conv_id", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))}
    for extra in ("t", "ref", "depth", "key", "words", "part", "length"):
        columns[extra] = pa.array(["x"] * len(talks))
    pq.write_table(pa.table(columns), d / "conversations.parquet")
    return str(d)


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, sf_dir):
    d = tmp_path_factory.mktemp("empty")
    for n in ("documents", "benchmark", "labels", "conversations"):
        pq.write_table(pq.read_table(f"{sf_dir}/{n}.parquet").slice(0, 0), d / f"{n}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def data():
    return rows()
