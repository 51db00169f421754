"""HTML extraction: a graphical model over the tree of a page tells its main text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodgeflow.llm.dom import Forest
from lodgeflow.llm.labelled_pages import labelled_pages

FIT_PAGES = 600         # labelled pages the model is fitted on
_BATCH = 2 << 20        # characters of pages that are judged together; a longer page is alone
_LENGTHS = np.array([10, 25, 60, 120, 300])
_WHOLE = np.array([1, 50, 200, 800, 3000])
_LINKS = np.array([1e-9, 0.34, 0.8])
_PART = np.array([0.02, 0.1, 0.3, 0.6, 0.9, 0.985])
_DIRECT = np.array([1e-9, 0.3, 0.7])
SHAPES = [f"{k}:{i}" for k, n in (("len", 6), ("link", 4), ("end", 2), ("commas", 3), ("whole", 6), ("links", 4), ("part", 7), ("direct", 4)) for i in range(n)]
#: Edges differ by the child: a plain element of running text, a plain one that holds others, any other, a piece of text.
FLOW = {"t:" + t for t in "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption thead tbody tfoot tr th".split()}
HOLD = {"t:" + t for t in "div section td table center".split()}
KINDS = 4


class Tree:
    """Arrays of a forest: nodes by depth, edges, and shape features."""

    def __init__(self, forest: Forest):
        self.parent = np.array(forest.parent, np.int64)
        depth = np.array(forest.depth, np.int64)
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        self.is_text = np.array([t is not None for t in forest.text], bool)
        plain = [w[0] if len(w) == 1 else "" for w in forest.words]
        self.kind = np.where(self.is_text, 3, [0 if w in FLOW else 1 if w in HOLD else 2 for w in plain])
        texts = ["".join(t).strip() if t is not None else "" for t in forest.text]
        chars = np.array([len(t) for t in texts], float)
        linked = np.minimum(np.array(forest.linked, float), chars)
        whole, whole_linked = chars.copy(), linked.copy()
        for at in self.levels[:0:-1]:
            whole += np.bincount(self.parent[at], whole[at], len(chars))
            whole_linked += np.bincount(self.parent[at], whole_linked[at], len(chars))
        child = np.flatnonzero((self.parent >= 0) & np.isin(self.kind, (0, 3)))
        direct = np.bincount(self.parent[child], whole[child], len(chars))   # in running text right below, not in further containers
        root = np.arange(len(chars))
        for at in self.levels[1:]:
            root[at] = root[self.parent[at]]
        share = lambda a, b: a / np.maximum(b, 1)
        marks = np.array([sum(t.count(c) for c in ",.;") for t in texts], float)
        ends = np.array([t[-1:] in tuple(".!?:;…\"'”»)") and bool(t) for t in texts], int)
        holds = np.isin(self.kind, (1, 2))                       # running text tells by its pieces
        cols, base = [], 0
        for on, value, n in ((self.is_text, np.searchsorted(_LENGTHS, chars, "right"), 6),
                             (self.is_text, np.searchsorted(_LINKS, share(linked, chars)), 4), (self.is_text, ends, 2),
                             (self.is_text, np.searchsorted([0.5, 1.5], share(marks * 100, chars)), 3),
                             (holds, np.searchsorted(_WHOLE, whole, "right"), 6),
                             (holds, np.searchsorted(_LINKS, share(whole_linked, whole)), 4),
                             (holds, np.searchsorted(_PART, share(whole, whole[root])), 7),
                             (holds, np.searchsorted(_DIRECT, share(direct, whole)), 4)):
            cols.append((np.flatnonzero(on), value[on] + base))
            base += n
        self.rows = np.concatenate([c[0] for c in cols])
        self.cols = np.concatenate([c[1] for c in cols])


def _sum(a: np.ndarray) -> np.ndarray:
    """log(exp + exp) over the last axis of two."""
    return np.logaddexp(a[..., 0], a[..., 1])


def marginals(tree: Tree, score: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product over all trees: upward, then downward. Probabilities of content by
    node, of (parent's label, own) by node but for roots, and the log partition sum.
    score: a node's log-odds. edge[kind]: log potentials of (parent's label, own)."""
    n = len(score)
    own = np.stack([np.zeros(n), score], axis=1)                 # with all that came from below
    up = np.zeros((n, 2))
    pair = edge[tree.kind]
    for at in tree.levels[:0:-1]:
        up[at] = _sum(pair[at] + own[at][:, None, :])
        for y in (0, 1):
            own[:, y] += np.bincount(tree.parent[at], up[at, y], n)
    belief = own.copy()
    total = float(_sum(own[tree.levels[0]]).sum()) if n else 0.0
    both = np.zeros((n, 2, 2))
    for at in tree.levels[1:]:
        rest = belief[tree.parent[at]] - up[at]                  # the parent's without what this child sent
        joint = rest[:, :, None] + pair[at] + own[at][:, None, :]
        belief[at] = np.logaddexp(joint[:, 0], joint[:, 1])
        flat = joint.reshape(-1, 4)
        flat = np.exp(flat - flat.max(axis=1, keepdims=True))
        both[at] = (flat / flat.sum(axis=1, keepdims=True)).reshape(-1, 2, 2)
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), both, total


class Model:
    """Weights of features, and the log potentials between parent and child."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray, edge: np.ndarray):
        self.vocabulary, self.weights, self.edge = vocabulary, weights, edge

    def features(self, forest: Forest, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        known, size = self.vocabulary, len(SHAPES)
        rows, cols = [], []
        for i, words in enumerate(forest.words):
            for w in () if tree.is_text[i] else words:
                c = known.get(w)
                if c is not None:
                    rows.append(i)
                    cols.append(size + c)
        return np.concatenate([tree.rows, np.array(rows, np.int64)]), np.concatenate([tree.cols, np.array(cols, np.int64)])

    def content(self, forest: Forest) -> np.ndarray:
        """Probability that each node belongs to the main text."""
        tree = Tree(forest)
        rows, cols = self.features(forest, tree)
        return marginals(tree, np.bincount(rows, self.weights[cols], len(forest.parent)), self.edge)[0]

    def texts(self, pages: list[str]) -> list[str]:
        forest = Forest()
        for page in pages:
            forest.add(page)
        content = self.content(forest)
        ends = [*forest.roots[1:], len(forest.parent)]
        out = []
        for a, b in zip(forest.roots, ends):
            parts: list[str] = []
            for i in range(a, b):
                if forest.text[i] is not None:
                    if forest.broken[i]:
                        parts.append(" ")
                    if content[i] > 0.5:
                        parts += forest.text[i]
            out.append(" ".join("".join(parts).split()))
        return out


def fit(pages: list[str], rounds: int = 200, penalty: float = 0.005) -> Model:
    """Weights of highest likelihood, less a penalty, for pages whose elements carry
    ``data-content``: 1 for the main text, 0 for what does not belong to it, both for all
    inside. The gradient is what the labels have of each feature and pair of labels
    less what the marginals expect."""
    forest = Forest()
    for page in pages:
        forest.add(page)
    seen: dict[str, int] = {}
    for words, text in zip(forest.words, forest.text):
        for w in () if text is not None else words:
            seen.setdefault(w, len(seen))
    tree = Tree(forest)
    size = len(SHAPES) + len(seen)
    model = Model(seen, np.zeros(size), np.zeros((KINDS, 2, 2)))
    rows, cols = model.features(forest, tree)
    label = np.array(forest.label)
    child = np.flatnonzero(tree.parent >= 0)
    want = np.zeros((KINDS, 2, 2))
    np.add.at(want, (tree.kind[child], label[tree.parent[child]], label[child]), 1)
    want_node = np.bincount(cols, label[rows], size)
    x = np.zeros(size + 4 * KINDS)
    first, second = np.zeros(len(x)), np.zeros(len(x))
    for k in range(1, rounds + 1):
        p, both, _ = marginals(tree, np.bincount(rows, x[:size][cols], len(label)), x[size:].reshape(KINDS, 2, 2))
        have = np.zeros((KINDS, 2, 2))
        np.add.at(have, tree.kind[child], both[child])
        grad = np.concatenate([want_node - np.bincount(cols, p[rows], size), (want - have).reshape(-1)]) / len(pages) - penalty * x / 20
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad ** 2
        x = x + 0.3 * (1 - 0.9 * k / rounds) * (first / (1 - 0.9 ** k)) / (np.sqrt(second / (1 - 0.99 ** k)) + 1e-8)
    return Model(seen, x[:size].copy(), x[size:].reshape(KINDS, 2, 2).copy())


@lru_cache(maxsize=2)
def default_model(pages: int = FIT_PAGES) -> Model:
    return fit(labelled_pages(pages))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", *, keep: tuple[str, ...] = (),
                 model: Model | None = None, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id_col, *keep, text) for every row of ``pages``: the main text of the whole page.

    The article without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, comments and markup. Character references are decoded; white space,
    ends of blocks and line breaks become one space each; ends are trimmed. Null, empty
    and blank pages, and pages without a main text, give ''. Broken markup never fails:
    tags need not be closed. Repeated rows and ids, and rows without an id, each return a
    row. An empty table returns no rows. Columns named in ``keep`` (any but ``text``) are
    returned as they are, others are ignored. Pages are judged alone, so neither skew nor
    order matters; a very long one is in memory as a whole.

    Method. A page is a tree of elements and pieces of text, each with an unknown label.
    A node's potential comes from its name, the words of its class, id and role, the
    lengths, links and punctuation of its text; an edge's from the labels of parent and
    child. Messages go upward from the leaves and downward from the root (sum-product),
    exact on a tree; pieces whose marginal exceeds one half are the text. Potentials are
    fitted with the same messages on ``fit_pages`` labelled pages
    (:func:`labelled_pages`), unless ``model`` brings others (:func:`fit`).
    """
    model = model or default_model(fit_pages)
    names = [id_col, *keep]
    narrow = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(names)), F.col(html_col).cast("string").alias("html"))
    narrow_names = narrow.columns[:-1]
    kinds = [f.dataType for f in narrow.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, to_arrow_type(kind)) for c, kind in zip(zip(*ids), kinds)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(model.texts(held), pa.string())], [*narrow_names, "text"])

        for b in batches:
            for key, html in zip(zip(*(b.column(c).to_pylist() for c in narrow_names)), b.column("html")):
                html = html.as_py() or ""
                if ids and size + len(html) > _BATCH:
                    yield flush()
                    ids, held, size = [], [], 0
                ids.append(key)
                held.append(html)
                size += len(html)
        if ids:
            yield flush()

    schema = ", ".join(f"{c} {kind.simpleString()}" for c, kind in zip(narrow_names, kinds))
    return narrow.mapInArrow(run, f"{schema}, text string").select(*(F.col(c).alias(n) for c, n in zip(narrow_names, names)), "text")
