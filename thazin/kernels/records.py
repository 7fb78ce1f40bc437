"""Sentence records of an analysed document, and their stand-off and task forms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def sentence_records(d: dict) -> list[dict]:
    """One record a sentence with spans inside it: tokens, phrases of all depths, clauses, entities and units, each numbered in order of place; what crosses a sentence is left out."""
    return [_record(d, k, s["first"], s["stop"]) for k, s in enumerate(d["sentences"])]


def _local(rows: list[dict], a: int, b: int, **names: str) -> list[dict]:
    """Rows that lie in the words [a, b), with local inclusive spans and the named fields, in order of place and first name."""
    kept = [{**{new: r[old] for new, old in names.items()}, "start": r["first"] - a, "end": r["last"] - a} for r in rows if a <= r["first"] <= r["last"] < b]
    by = next(iter(names))
    return [{"id": i, **r} for i, r in enumerate(sorted(kept, key=lambda r: (r["start"], r["end"], r[by])))]


def _record(d: dict, k: int, a: int, b: int) -> dict:
    units = [{"category": u["category"], "first": u["index"], "last": u["index"]} for u in d["units"]]
    return {
        "id": k,
        "text": d["sentences"][k]["text"],
        "tokens": [{"id": i, "text": w, "pos": t} for i, (w, t) in enumerate(zip(d["words"][a:b], d["tags"][a:b]))],
        "chunks": _local([p for p in d["phrases"] if p["sentence"] == k], a, b, type="type", function="function", semantic_role="role"),
        "clauses": _local([c for c in d["clauses"] if c["sentence"] == k], a, b, type="kind", relation="relation", marker="marker"),
        "entities": _local(d["entities"], a, b, label="type"),
        "mwe": _local(units, a, b, type="category"),
    }


def token_spans(text: str, tokens: Sequence[str]) -> list[tuple[int, int]]:
    """Where each token stands, searched forward; one that isn't found takes its length at the place reached, as far as the text goes."""
    out, at = [], 0
    for t in tokens:
        found = text.find(t, at)
        start = at if found < 0 else found
        at = min(start + len(t), len(text))
        out.append((start, at))
    return out


def annotations(r: dict) -> Iterator[tuple[str, int, int]]:
    """(label, start, end) in characters of a record's text: entities, phrases, units and clauses in this order; empty spans are left out."""
    spans = token_spans(r["text"], [t["text"] for t in r["tokens"]])
    for name, field, prefix in (("entities", "label", ""), ("chunks", "type", "CHUNK/"), ("mwe", "type", "MWE/"), ("clauses", "type", "CLAUSE/")):
        for x in r[name]:
            start, end = spans[x["start"]][0], spans[x["end"]][1]
            if end > start:
                yield (prefix + x[field]).replace(" ", "_"), start, end


def standoff(records: Sequence[dict]) -> tuple[str, str]:
    """(text, annotations) of a document in stand-off form: sentences on lines of their own, spans into the whole text."""
    lines, base = [], 0
    for r in records:
        for label, start, end in annotations(r):
            lines.append(f"T{len(lines) + 1}\t{label} {base + start} {base + end}\t{r['text'][start:end]}\n")
        base += len(r["text"]) + 1
    return "\n".join(r["text"] for r in records), "".join(lines)


def task(r: dict) -> dict:
    """A record as a labelling task with its annotations as predictions."""
    result = [{"from_name": "label", "to_name": "text", "type": "labels", "value": {"start": a, "end": b, "text": r["text"][a:b], "labels": [label]}} for label, a, b in annotations(r)]
    return {"data": {"text": r["text"]}, "predictions": [{"result": result}]}
