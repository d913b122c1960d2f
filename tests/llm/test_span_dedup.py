import re

from feedloom.llm import span_dedup

ENDS = re.compile(r"(?<=[.!?。！？…])\s+|\s*\n\s*")


def clauses(text):
    out, at = [], 0
    for end in [m.end() for m in ENDS.finditer(text)] + [len(text)]:
        words = text[at:end].split()
        at = end
        out += [words[k:k + 12] for k in range(0, len(words), 12)]
    return out


def runs(parts, words=30):
    found, ends = [], set()
    for i in range(len(parts)):
        total = 0
        for j in range(i, len(parts)):
            total += len(parts[j])
            if total >= words:
                found.append((i, j + 1))
                ends.add(j + 1)
                break
    for j in set(range(1, len(parts) + 1)) - ends:
        total = 0
        for i in range(j - 1, -1, -1):
            total += len(parts[i])
            if total >= words:
                found.append((i, j))
                break
    return sorted(found)


def brute_force(texts):
    """doc -> the words that stay."""
    seen, out = set(), {}
    for d in sorted(texts):
        parts, gone = clauses(texts[d]), set()
        for b, e in runs(parts):
            key = tuple(w.lower() for p in parts[b:e] for w in p)
            if key in seen:
                gone.update(range(b, e))
            seen.add(key)
        out[d] = [w for k, p in enumerate(parts) if k not in gone for w in p]
    return out


PASSAGE = " ".join(f"Word{k} and some more of it." for k in range(12))


def test_passages_go_but_for_the_first(spark, documents):
    texts = {1: "A start. " + PASSAGE, 2: PASSAGE + "\nAn end here.", 3: "x " * 200, 4: "", 5: f"Own words first.\n{PASSAGE}\n{PASSAGE}",
             6: "short", 7: "One sentence " + "that never ends " * 40, 8: "Another. One sentence " + "that never ends " * 40}
    rows = [(d, t) for d, t in texts.items()] + [(None, None)]
    got = {r["doc_id"]: r for r in span_dedup.remove_repeats(documents(rows)).collect()}
    assert got[None]["text"] is None and got[None]["n_removed"] == 0
    assert {d: got[d]["text"].split() for d in texts} == brute_force(texts)
    assert got[1]["text"] == texts[1] and got[2]["text"] == "An end here."


def test_tables_with_odd_shapes(spark, documents):
    assert span_dedup.remove_repeats(documents([])).count() == 0
    extra = documents([(1, PASSAGE, "a"), (2, PASSAGE, "b"), (2, PASSAGE, "b"), (3, "fine text", "c")], "doc_id long, text string, hash string")
    got = span_dedup.remove_repeats(extra)
    assert got.columns == ["doc_id", "text", "hash", "n_removed"]
    # Rows that share an id are one document to the order, so both copies of row 2 lose what row 1 has first.
    assert sorted((r["doc_id"], r["text"], r["hash"]) for r in got.collect()) == [
        (1, PASSAGE, "a"), (2, "", "b"), (2, "", "b"), (3, "fine text", "c")]
