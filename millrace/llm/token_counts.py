"""Token counts under a unigram language model, by dynamic programming shared over a trie.

The vocabulary is a public one, its file a parameter: pieces in the order of their ranks, the
probability of rank r taken in proportion to 1 / (r + 1) (Zipf), as scores in whole 1e-4 nats so
that sums are exact. A text's pre-tokens are its words between ASCII white space with a word mark
before. A pre-token's tokens are those of its best segmentation, by score, then by fewer tokens; a
character outside the vocabulary costs one token for each of its bytes.

Distinct pre-tokens go into a trie. A node holds the best (score, tokens) of the prefix that it
spells, worked out once from its ancestors' however many pre-tokens share the prefix; a terminal
holds its pre-token's count. Nodes are kept for the first DEPTH characters; what follows in a longer
pre-token is worked out from its node there in the same way, without nodes. The trie and the table
of counts live as long as a task and are emptied beyond a bound, which changes no count.

Defined results: a null or empty text has no pre-tokens and no tokens; rows are mapped one to
one, so repeated rows and null keys are kept; a pre-token of any length is worked out whole; of
segmentations of one score the one with fewer tokens counts; an empty table gives no rows; columns
beyond key and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_batches, slices

MARK = "▁"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters of a pre-token that have nodes in the trie.
DEPTH = 64
MOST_NODES, MOST_WORDS = 600_000, 300_000


#: A path's worth in one number: its score in units of TOKEN, less its tokens. Spark's strings have
#: less than 2**31 bytes and a byte is a token at most, so tokens never reach into the score.
TOKEN = 1 << 32
_KEY = 1 << 21


class Unigram:
    """Worths of pieces; a byte of an unknown character scores below the last rank."""

    def __init__(self, pieces: Iterable[str]) -> None:
        ranked = list(dict.fromkeys(pieces))
        total = math.log(sum(1 / (r + 1) for r in range(len(ranked))) or 1)
        worth = lambda r: -round(1e4 * (math.log(r + 1) + total)) * TOKEN - 1
        self.worth = {p: worth(r) for r, p in enumerate(ranked)}
        self.byte = worth(len(ranked) + 1)
        self.longest = max(map(len, ranked), default=1)
        self.single = {p: w for p, w in self.worth.items() if len(p) == 1}
        #: By their last two characters, the lengths of the longer pieces, rising.
        ends: dict[str, set[int]] = {}
        for p in ranked:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {last: tuple(sorted(sizes)) for last, sizes in ends.items()}

    def step(self, spelled: str, best: list[int]) -> int:
        """The best worth of spelled, given those of its shorter prefixes, the last ones of which are enough."""
        c = spelled[-1]
        own = self.single.get(c)
        out = best[-1] + (len(c.encode("utf-8", "surrogatepass")) * self.byte if own is None else own)
        n = len(spelled)
        for k in self.ends.get(spelled[-2:], ()):
            if k > n:
                break
            found = self.worth.get(spelled[n - k :])
            if found is not None and best[-k] + found > out:
                out = best[-k] + found
        return out


class Trie:
    """Nodes by number: children by node and character, and the best worth of what each spells."""

    def __init__(self, model: Unigram) -> None:
        self.model, self.steps = model, 0
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.forward: list[int] = [0]

    def insert(self, word: str) -> int:
        """Add a pre-token; its count of tokens, from the worths of its prefixes, seen only as far back as a piece can reach."""
        children, forward, step, longest = self.children, self.forward, self.model.step, self.model.longest
        node, best = 0, [0]
        for n, c in enumerate(word[:DEPTH], 1):
            key = node * _KEY + ord(c)
            child = children.get(key)
            if child is None:
                children[key] = child = len(forward)
                forward.append(step(word[:n], best))
                self.steps += 1
            node = child
            best.append(forward[node])
        for n in range(DEPTH + 1, len(word) + 1):
            best.append(step(word[max(0, n - longest) : n], best))
            if len(best) > 4 * longest + DEPTH:
                del best[: -longest - 1]
        return -best[-1] % TOKEN


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model by rank, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))]
    return [model.id_to_piece(k) for k in sorted(plain, key=lambda k: (-model.get_score(k), k))]


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[list]:
    model = Unigram(vocabulary(path))
    trie, counts = Trie(model), {}
    for batch in batches:
        for part in slices(batch):
            tokens, pre = [], []
            for text in part.column(1).to_pylist():
                words = _WORDS.findall(text or "")
                for w in sorted(w for w in set(words) if w not in counts):
                    counts[w] = trie.insert(MARK + w)
                tokens.append(sum(map(counts.__getitem__, words)))
                pre.append(len(words))
                if len(counts) > MOST_WORDS or len(trie.forward) > MOST_NODES:
                    counts.clear()
                    trie.clear()
            yield [part.column(0), tokens, pre]


def count_tokens(texts: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_pretokens), a row for each row of texts."""
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([texts.schema[key], StructField("n_tokens", LongType()), StructField("n_pretokens", LongType())])
    rows = texts.select(key, texts[text].alias("text"))
    return map_batches(rows, _counted, schema, model_path)
