"""License scans: templates with optional and replaceable regions, compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .text_kernels import Texts, byte_table, text_chunks

#: Bytes between words: ASCII characters other than digits and lower-case letters (A-Z are lowered before).
SEPARATORS = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

#: The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^<>]*)?)>>")


def words_of(text: str) -> list[str]:
    """Runs of digits, letters and all non-ASCII characters, with A-Z lowered."""
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@dataclass
class Automaton:
    """States are numbered; a state has words that lead on, a state that any word leads to, and free moves."""

    label: str
    base: bool
    on: list[dict[str, int]] = field(default_factory=list)
    any_word: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    final: int = 0
    full: int = 0
    mandatory: list[str] = field(default_factory=list)

    def state(self) -> int:
        self.on.append({})
        self.any_word.append(None)
        self.free.append([])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def first_words(self) -> set[str]:
        """The words with which a text of the template can begin."""
        return {w for s in self.closed({0}) for w in self.on[s]}

    def longest(self, words: list[str], at: int) -> int:
        """How many words from ``at`` on the longest text of the template takes; 0 without one."""
        states, best, n = self.closed({0}), 0, 0
        while states and at + n < len(words):
            word = words[at + n]
            states = self.closed({t for s in states for t in (self.on[s].get(word), self.any_word[s]) if t is not None})
            n += 1
            if self.final in states:
                best = n
        return best


def compiled(label: str, template: str, base: bool = False) -> Automaton:
    """The automaton of a template. A template must not begin with a replaceable region, and needs a mandatory word."""
    out = Automaton(label, base)
    here, opened, position = out.state(), [], 0
    for part in [*_MARKUP.finditer(template), None]:
        for word in words_of(template[position : part.start() if part else len(template)]):
            after = out.state()
            out.on[here][word] = after
            here, out.full = after, out.full + 1
            if not opened:
                out.mandatory.append(word)
        if part is None:
            break
        position = part.end()
        if part[1] == "beginOptional":
            inner = out.state()
            out.free[here].append(inner)
            opened.append(here)
            here = inner
        elif part[1] == "endOptional":
            after = out.state()
            out.free[here].append(after)
            out.free[opened.pop()].append(after)
            here = after
        else:
            low, high = map(int, re.search(r"words=(\d+)-(\d+)", part[2]).groups())
            skips = []
            for i in range(high):
                if i >= low:
                    skips.append(here)
                after = out.state()
                out.any_word[here] = after
                here = after
            for s in skips:
                out.free[s].append(here)
    if opened:
        raise ValueError(f"an optional region of {label} has no end")
    if not out.mandatory or out.any_word[0] is not None:
        raise ValueError(f"a template of {label} has no mandatory word, or begins with a replaceable region")
    out.final = here
    return out


def automata(notices: dict[str, tuple[str, ...]] | None = None) -> list[Automaton]:
    """The base phrases' automata and those of the notices."""
    base = [compiled(label, phrase, base=True) for phrase, label in BASE_PHRASES.items()]
    own = NOTICES if notices is None else notices
    return base + [compiled(label, template) for label, templates in own.items() for template in templates]


def scan(words: list[str], starts: list[int], machines: list[Automaton], by_word: dict[str, list[Automaton]]) -> dict:
    """What the automata find from the given places on."""
    places: list[int] = []
    base_labels, labels, score = set(), set(), 0.0
    for at in starts:
        for machine in by_word.get(words[at], ()):
            taken = machine.longest(words, at)
            if not taken:
                continue
            labels.add(machine.label)
            if machine.base:
                places.append(at)
                base_labels.add(machine.label)
                score = max(score, 0.5)
            else:
                score = max(score, 0.5 + 0.5 * min(1.0, taken / machine.full))
    return {"places": places, "base_labels": base_labels, "labels": labels, "score": score}


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Texts(data, np.array([0, len(data)])).hashes(np.array([0]), np.array([len(data)]))[0])


_FOUND = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _find(notices: dict[str, tuple[str, ...]] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata(notices)
        by_word: dict[str, list[Automaton]] = {}
        for machine in machines:
            for word in machine.first_words():
                by_word.setdefault(word, []).append(machine)
        heads = np.array([_hash_of(w) for w in by_word], dtype=np.uint64)
        reach = max(len(m.on) for m in machines)
        # Each template's longest mandatory word: a text without any of these holds no license.
        kernels = np.array([_hash_of(w) for w in {max(m.mandatory, key=lambda w: (len(w), w)) for m in machines}], dtype=np.uint64)
        for batch in batches:
            for at, end, texts in text_chunks(batch.column(1)):
                texts = texts.lower_ascii()
                starts, ends, first = texts.words(SEPARATORS)
                hashes = texts.hashes(starts, ends)
                is_head, marks = np.isin(hashes, heads), np.concatenate(([0], np.cumsum(np.isin(hashes, kernels))))
                rows = []
                for i in range(len(texts)):
                    low, high = int(first[i]), int(first[i + 1])
                    row = (high - low, 0, None, None, "", "", 0.0)
                    if marks[high] > marks[low]:
                        heads_here = np.flatnonzero(is_head[low:high])
                        near = np.minimum(low + heads_here + reach, high)
                        candidates = heads_here[marks[near] > marks[low + heads_here]].tolist()
                        if candidates:
                            data = texts.data
                            # Only the words that automata can reach from the candidates are decoded.
                            words = _Window(data, starts[low:high], ends[low:high])
                            found = scan(words, candidates, machines, by_word)
                            places = found["places"]
                            row = (high - low, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found["base_labels"])), ",".join(sorted(found["labels"])), found["score"])
                    rows.append(row)
                yield pa.record_batch([batch.column(0)[at:end], *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_FOUND)[1:], strict=True))], schema=_FOUND)

    return run


class _Window:
    """A text's words, decoded when asked for."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()


def license_scan(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Texts are compared word by word: A-Z are lowered, words are runs of digits, letters and non-ASCII
    characters. A template's automaton accepts what has its mandatory words exactly, with or without its
    optional regions, and any words, as many as allowed, in its replaceable ones. ``n_base`` counts all
    places of the base phrases, which are templates without such regions; ``first_word`` and
    ``last_word`` are their smallest and largest starts. ``labels`` adds those of the notices found. The
    score is 0 without a match, 0.5 with base phrases alone, and nears 1 as more of a notice's words
    stand in the text. ``notices`` (:data:`outcomelake.llm.license_texts.NOTICES` without it) gives the templates
    by label; texts that hold none of the templates' longest mandatory words are passed over.

    Defined cases: templates that match at one place all count, the best of them for the score. a null or empty text has no words and score 0. Null ids and repeated rows are scanned
    like others. Other columns are ignored. An empty table gives an empty result.
    """
    docs = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_find(notices), schema).withColumnRenamed("id", id_col)
