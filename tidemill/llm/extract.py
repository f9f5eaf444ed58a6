"""HTML extraction: a linear-chain conditional random field over leaf blocks.

A page is cut to leaf blocks. A block's features are its ancestors' tags and the words
of their class, id and role names, its own tag, and properties of its text. The field
has two labels, main text and other, with weights per feature and for each pair of
neighbouring labels; it is trained by maximum likelihood (exact forward-backward
gradients) on the labelled pages of ``training_pages`` and decoded by Viterbi. The
main text of a page is its main blocks in page order, one to a line. No block is
capped or dropped otherwise.

Defined results: a null or empty page has an empty text; null or repeated ids are
kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import dom, scan, training_pages

PAGES, STEPS, RATE, DECAY = 400, 250, 0.15, 1e-4
#: Words that tell notices, adverts and footers.
CUES = ("cookie", "privacy", "subscribe", "newsletter", "rights reserved", "copyright", "©", "log in", "sign up", "advert", "powered by", "wrote:")
#: Characters to a cue at the first of the steps by which the density of cues is told.
SPARSE = 400
NAME_WORD = re.compile(r"[a-z]+")


def names_of(tag: str, attributes: dict) -> list[str]:
    """Features that an element gives to all blocks below it."""
    found = [f"in:{tag}"]
    for key in ("class", "id", "role"):
        if key in attributes:
            found += [f"named:{word}" for word in NAME_WORD.findall(attributes[key].lower())]
    return found


def text_features(leaf: dom.Leaf) -> list[str]:
    text = leaf.text
    n = len(text)
    low = text.lower()
    cues = [cue for cue in CUES if cue in low]
    found = [
        f"own:{leaf.tag}",
        f"size:{min(n.bit_length(), 11)}",
        f"links:{int(leaf.linked * 4)}",
        f"end:{text[-1] if text[-1] in '.!?:,' else 'x'}",
        f"comma:{',' in text}",
    ]
    if cues:
        # An article may hold a cue or two; how many different ones, and how dense, tells a notice of any length.
        found += [f"cues:{min(len(cues), 4)}", f"dense:{min((len(cues) * SPARSE // n).bit_length(), 5)}"]
    return found


class Model:
    """Feature ids, their weights for main text, and weights of label pairs."""

    def __init__(self, ids: dict[str, int], weight: np.ndarray, pairs: np.ndarray):
        self.ids, self.weight, self.pairs = ids, weight, pairs
        self.by_feature = {name: float(weight[k]) for name, k in ids.items()}

    def enter(self, context, tag, attributes):
        """A context is (features known to the model, their weight)."""
        new = [x for x in names_of(tag, attributes) if x in self.by_feature and x not in context[0]]
        if not new:
            return context
        both = context[0].union(new)
        return both, sum(map(self.by_feature.get, both))

    def main_text(self, page: str | None) -> str:
        blocks = list(dom.leaves(page or "", (frozenset(), 0.0), self.enter))
        scores = [leaf.context[1] + sum(self.by_feature.get(x, 0.0) for x in text_features(leaf)) for leaf in blocks]
        return "\n".join(leaf.text for leaf, label in zip(blocks, viterbi(scores, self.pairs), strict=True) if label)


def viterbi(scores: list[float], pairs: np.ndarray) -> list[int]:
    """The most likely labels; a block's score is that of label 1 over label 0."""
    if not scores:
        return []
    (a, b), (c, d) = pairs.tolist()
    zero, one = 0.0, scores[0]
    back = []
    for s in scores[1:]:
        back.append((c + one > a + zero, d + one > b + zero))
        zero, one = max(a + zero, c + one), max(b + zero, d + one) + s
    label = int(one > zero)
    found = [label]
    for step in reversed(back):
        label = int(step[label])
        found.append(label)
    return found[::-1]


def _labelled(page: str):
    """(features, label) of each block of a training page."""

    def enter(context, tag, attributes):
        return context[0].union(names_of(tag, attributes)), int(attributes.get("data-y", context[1]))

    return [([*leaf.context[0], *text_features(leaf)], leaf.context[1]) for leaf in dom.leaves(page, (frozenset(), 0), enter)]


def _marginals(scores, mask, pairs):
    """P(label 1) per block and expected label pairs, of pages padded to one length."""
    n, length = scores.shape
    ahead = np.zeros((length, n, 2))
    behind = np.zeros((length, n, 2))
    unary = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead[0] = unary[:, 0]
    for t in range(1, length):
        step = np.logaddexp(ahead[t - 1][:, :1] + pairs[0], ahead[t - 1][:, 1:] + pairs[1]) + unary[:, t]
        ahead[t] = np.where(mask[:, t, None], step, ahead[t - 1])
    whole = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
    for t in range(length - 2, -1, -1):
        later = behind[t + 1] + unary[:, t + 1]
        step = np.logaddexp(pairs[:, 0] + later[:, :1], pairs[:, 1] + later[:, 1:])
        behind[t] = np.where(mask[:, t + 1, None], step, behind[t + 1])
    one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - whole).T
    later = behind[1:] + unary.transpose(1, 0, 2)[1:]
    both = np.exp(ahead[:-1, :, :, None] + pairs + later[:, :, None, :] - whole[None, :, None, None])
    return one, (both * mask.T[1:, :, None, None]).sum((0, 1))


@functools.cache
def train(count: int = PAGES, steps: int = STEPS) -> Model:
    pages = [x for x in map(_labelled, training_pages.pages(count) + training_pages.site_pages(count) + training_pages.long_notices(count // 2)) if x]
    ids: dict[str, int] = {}
    for page in pages:
        for names, _ in page:
            for name in names:
                ids.setdefault(name, len(ids))
    length = max(map(len, pages))
    mask = np.zeros((len(pages), length), bool)
    labels = np.zeros((len(pages), length))
    flat, owner = [], []
    for p, page in enumerate(pages):
        for t, (names, label) in enumerate(page):
            mask[p, t], labels[p, t] = True, label
            flat += [ids[x] for x in names]
            owner += [p * length + t] * len(names)
    flat, owner = np.array(flat), np.array(owner)
    seen = labels.astype(int)
    pairs_seen = np.zeros((2, 2))
    np.add.at(pairs_seen, (seen[:, :-1][mask[:, 1:]], seen[:, 1:][mask[:, 1:]]), 1)

    value = np.zeros(len(ids) + 4)
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, steps + 1):
        weight, pairs = value[:-4], value[-4:].reshape(2, 2)
        scores = np.bincount(owner, weight[flat], mask.size).reshape(mask.shape)
        one, both = _marginals(scores, mask, pairs)
        wrong = ((one - labels) * mask).ravel()
        slope = np.concatenate([np.bincount(flat, wrong[owner], len(ids)), (both - pairs_seen).ravel()]) / len(pages) + DECAY * value
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        value = value - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(ids, value[:-4], value[-4:].reshape(2, 2))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    scan.small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def extracted(batches):
        for batch in batches:
            texts = [shared.value.main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    narrow = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html")
    return narrow.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op1_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
