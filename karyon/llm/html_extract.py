"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into its leaf blocks in order. Each block has binary features: its ancestors' tags, the words of
their classes, ids and roles, and of its text the length, the share inside links, its ending and a copyright sign. The field scores a
label (main or not) for each block and each pair of neighbours; it is trained on labelled pages by gradient
steps on the log-likelihood (forward-backward) and decoded by Viterbi. The training pages are generated from a seed
with known labels (`html_pages`) in several independent layouts, as the table of pages has none; tests leave each layout out of training in turn.

Result: blocks labelled main, white space inside a block as one space, joined by two line ends. A null or empty page, or one without
main blocks, gives an empty text. Repeated rows give repeated results; an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_blocks import Block, page_blocks
from .html_pages import LAYOUTS, labelled_pages

TRAINING_PAGES = 600
STEPS = 250


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = b.linked / max(1, len(b.text))
    found = [f"parent:{b.parent}", f"words:{min(words.bit_length(), 7)}", f"linked:{min(int(share * 4), 3)}"]
    found.append("ends" if b.text[-1:] in ".!?:;\"'”»" else "open")
    if "©" in b.text or "copyright" in b.text.lower():
        found.append("copyright")
    found.append("bias")
    return found


def block_features(b: Block) -> list[str]:
    return [*b.around, *text_features(b)]


@dataclass
class Field:
    weights: dict[str, float]  # score of main less that of other
    start: np.ndarray
    follow: np.ndarray  # [label, next label]

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels, by Viterbi."""
        if not blocks:
            return []
        get = self.weights.get
        (stay0, up), (down, stay1) = self.follow.tolist()
        back: list[tuple[int, int]] = []
        zero, one = self.start.tolist()
        around: dict[int, float] = {}  # blocks of one element share its set of features

        def score(b: Block) -> float:
            key = id(b.around)
            if key not in around:
                around[key] = sum([get(f, 0.0) for f in sorted(b.around)])
            return around[key] + sum([get(f, 0.0) for f in text_features(b)])

        one += score(blocks[0])
        for b in blocks[1:]:
            own = score(b)
            back.append((0 if zero + stay0 >= one + down else 1, 0 if zero + up >= one + stay1 else 1))
            zero, one = max(zero + stay0, one + down), max(zero + up, one + stay1) + own
        label = int(one > zero)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, rate: float = 0.05, decay: float = 2e-4) -> Field:
    """Adam on the mean log-likelihood of the labels; all pages at each step, padded to the longest."""
    pages = [p for p in pages if p[0]]
    features = [[block_features(b) for b in blocks] for blocks, _ in pages]
    index = {f: k for k, f in enumerate(sorted({f for page in features for block in page for f in block}))}
    n, longest = len(pages), max(len(p[0]) for p in pages)
    x = np.zeros((n, longest, len(index)), np.float32)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    for i, page in enumerate(features):
        for t, block in enumerate(page):
            x[i, t, [index[f] for f in block]] = 1
        y[i, : len(page)] = pages[i][1]
        mask[i, : len(page)] = True
    flat = x.reshape(-1, len(index))
    params = [np.zeros(len(index)), np.zeros(2), np.zeros((2, 2))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        weights, start, follow = params
        score = np.zeros((n, longest, 2))
        score[:, :, 1] = (flat @ weights.astype(np.float32)).reshape(n, longest)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            own = np.logaddexp.reduce(forward[:, t - 1, :, None] + follow, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], own, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            own = np.logaddexp.reduce(follow + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None], own, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
        truth = np.stack([y == 0, y == 1], axis=2) * mask[:, :, None]
        grads = [((single[:, :, 1] - truth[:, :, 1]).reshape(-1).astype(np.float32) @ flat).astype(float) / n, (single[:, 0] - truth[:, 0]).sum(axis=0) / n, np.zeros((2, 2))]
        for t in range(1, longest):
            on = mask[:, t]
            pair = np.exp(forward[on, t - 1, :, None] + follow + (score[on, t] + backward[on, t])[:, None, :] - total[on, None, None])
            grads[2] += (pair.sum(axis=0) - np.bincount(y[on, t - 1] * 2 + y[on, t], minlength=4).reshape(2, 2)) / n
        for k, g in enumerate(grads):
            g = g + decay * params[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(params[0][k]) for f, k in index.items()}, params[1], params[2])


@lru_cache(maxsize=8)
def trained_field(without: str = "", pages: int = TRAINING_PAGES) -> Field:
    """Trained on generated pages of all layouts but one; a sixth as many of each small layout as of `parts`."""
    made = [labelled_pages(pages if layout == "parts" else pages // 6, layout, seed=5 + k) for k, layout in enumerate(LAYOUTS) if layout != without]
    return train([p for own in made for p in own])


def main_text(html: str | None, field: Field) -> str:
    blocks = page_blocks(html, field.weights.__contains__)
    return "\n\n".join(b.text for b, label in zip(blocks, field.decode(blocks), strict=True) if label)


def extract_pages(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page; one pass, no shuffle."""
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                rows = batch.slice(first, 256)
                field = shared.value
                texts = [main_text(html.as_py(), field) for html in rows.column(2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars bigint")
