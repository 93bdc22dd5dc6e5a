"""A small causal self-attention model in numpy, for operator 6.

Subword ids come in. A subword is predicted by its class and its share of the class, which comes from
corpus counts: with follow(), counts after the subword before it. SINGLE of the most frequent subwords
may be predicted one by one instead. One head attends over a window with learned relative-position
offsets. Since keys, queries and values depend on a subword alone, scoring reads them from tables.
"""

from __future__ import annotations

import numpy as np

#: Positions of a window that are scored, and those before them that are context only.
SCORED, CONTEXT = 24, 8
WINDOW = SCORED + CONTEXT
#: Subwords with an embedding of their own, embedding size, head size; most frequent subwords that are predicted one by one, classes of the others.
ROWS, WIDTH, HEAD, SINGLE, CLASSES = 8192, 16, 8, 0, 32
OUTPUTS = SINGLE + CLASSES
#: Most frequent subwords that tell classes apart, and shares of a class, where they come before.
BEFORE = 512
#: The start: steps, windows a step, step size. Step size of the rounds after it. Windows scored at once.
STEPS, WINDOWS, RATE, ROUND_RATE, BATCH = 600, 64, 0.01, 0.002, 64


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's text and its first scored position, for texts of so many tokens."""
    many = -(-counts // SCORED)
    text = np.repeat(np.arange(len(counts)), many)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * SCORED


def rate(step: int) -> float:
    """The step size of the start."""
    return RATE * min(1.0, 2 * (1 - step / STEPS))


def tables(p: dict[str, np.ndarray], e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By embedding e: queries; keys, values and a one, which sums weights; and what it adds to the exponents of outputs."""
    ones = np.ones((len(e), 1), e.dtype)
    return e @ (p["q"] * np.asarray(HEAD**-0.5, e.dtype)), np.concatenate([e @ p["k"], e @ p["v"], ones], 1), e @ p["o"][:WIDTH] + p["b"]


def outputs(h: np.ndarray, out: np.ndarray, base: np.ndarray, y: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of h @ out + base, whose exponents end at 60, in room; the exponent of output y in each row; each row's sum."""
    z, at = np.matmul(h, out, out=room[: len(h)]), np.arange(0, len(h) * OUTPUTS, OUTPUTS) + y
    z += base
    own = z.ravel().take(at)
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    total = z @ np.ones(OUTPUTS, z.dtype)
    if not total.max(initial=0) < 1e26:  # exp(60) is more; then, or with overflow, once more with the bound
        z = np.minimum(h @ out + base, 60)
        own = z.ravel().take(at)
        np.exp(z, out=z)
        total = z @ np.ones(OUTPUTS, z.dtype)
    return z, own, total


def crossed(a: np.ndarray, b: np.ndarray, rows: int = 512) -> np.ndarray:
    """a.T @ b, by so many rows at once, which takes half the time of all at once."""
    n = len(a) // rows * rows
    out = a[n:].T @ b[n:]
    return out + (a[:n].reshape(-1, rows, a.shape[1]).transpose(0, 2, 1) @ b[:n].reshape(-1, rows, b.shape[1])).sum(0) if n else out


def attended(q: np.ndarray, k: np.ndarray, val: np.ndarray, offsets: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of each window's positions, not yet divided by their sums, and the values under them; val ends with a one."""
    a = q @ k.transpose(0, 2, 1)
    a += offsets
    a[opens, :, :CONTEXT] = -1e9
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        mixed = a @ val
    if not (mixed[:, :, -1].min(initial=1) > 1e-26 and mixed[:, :, -1].max(initial=1) < 1e26):  # once more, from each row's largest exponent
        a = q @ k.transpose(0, 2, 1) + offsets
        a[opens, :, :CONTEXT] = -1e9
        a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        mixed = a @ val
    return a, mixed


class Attention:
    """counts: of each subword id in the whole corpus, the end id last. train() then gives it its weights."""

    def __init__(self, counts: np.ndarray) -> None:
        self.end, self.counts, self.after = len(counts) - 1, counts, None
        often = np.argsort(-counts, kind="stable")[:ROWS]
        self.row = np.full(len(counts), ROWS, np.int32)  # all rarer subwords share the last row
        self.row[often] = np.arange(len(often))

    def contexts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Each token of the texts as a cell of the table that cluster() takes: its row, and what comes before it among the first BEFORE rows."""
        before = np.concatenate([x for t in texts for x in ([self.end], t[:-1])])
        after = np.concatenate(texts)
        return self.row[after].astype(np.int64) * BEFORE + np.minimum(self.row[before], BEFORE - 1)

    def cluster(self, table: np.ndarray) -> None:
        """Classes by what comes before a subword, from the counts of contexts(): k-means over singular vectors. The end and the rare have their own."""
        table = table.reshape(ROWS + 1, BEFORE).astype(np.float32)
        mass = table.sum(1)
        unit = np.sqrt(table / np.maximum(mass[:, None], 1))
        _, vectors = np.linalg.eigh((unit * mass[:, None]).T @ unit)
        points = unit @ vectors[:, -17:-1]
        rng, k = np.random.RandomState(3), CLASSES - 2
        seen = np.flatnonzero(mass > 0)
        centres = points[rng.choice(seen, k, len(seen) < k, mass[seen] / mass.sum())]
        for _ in range(20):
            own = (np.square(centres).sum(1) - 2 * points @ centres.T).argmin(1)
            for c in range(k):
                if (w := mass * (own == c)).sum() > 0:
                    centres[c] = (points * w[:, None]).sum(0) / w.sum()
        self.class_of = np.append(own[:-1], k)[self.row].astype(np.int64)
        single = self.row < SINGLE
        self.class_of[single] = CLASSES + self.row[single]
        self.class_of[self.end] = k + 1
        smooth = self.counts + 0.1
        self.share = np.log(smooth / np.bincount(self.class_of, smooth, OUTPUTS)[self.class_of]).astype(np.float32)

    def follow(self, table: np.ndarray) -> None:
        """From the counts of contexts(): subwords with a row of their own have shares of their class after each of the first BEFORE rows.

        Witten and Bell's: as many counts as the class has different subwords there are dealt by the shares in the whole corpus.
        """
        table = table.reshape(ROWS + 1, BEFORE)[:ROWS]
        member = np.flatnonzero((self.row < ROWS))  # one subword a row
        member = member[np.argsort(self.row[member])]
        own, share = self.class_of[member], self.share[member]
        self.after = np.zeros((ROWS, BEFORE), np.float32)
        for c in np.unique(own):
            at = np.flatnonzero(own == c)
            part = table[at]
            kinds = np.maximum((part > 0).sum(0), 1)
            self.after[at] = np.log((part + kinds * np.exp(share[at].astype(np.float64))[:, None]) / (part.sum(0) + kinds))

    def inside(self, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The log of each subword's share of its class; with follow(), after the row before it."""
        out = self.share[y]
        if self.after is not None:
            row = self.row[y]
            at = np.flatnonzero(row < ROWS)
            out[at] = self.after[row[at], np.minimum(before[at], BEFORE - 1)]
        return out

    def _layout(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Input rows by window, scored subwords, which of those are real, and windows that open a text."""
        counts = np.array([len(t) for t in texts])
        text, first = windows(counts)
        flat = np.concatenate([np.zeros(CONTEXT + 1, texts[0].dtype), *texts, np.zeros(WINDOW, texts[0].dtype)])
        at = (((np.cumsum(counts) - counts)[text] + first)[:, None] + np.arange(WINDOW)).astype(np.int32)  # of the inputs
        inputs = self.row.take(flat).take(at)
        opens = first == 0
        inputs[opens, CONTEXT] = self.row[self.end]  # a text opens after an end
        real = first[:, None] + np.arange(SCORED) < counts[text][:, None]
        return inputs, flat.take(at[:, CONTEXT:] + 1), real, opens, text

    @staticmethod
    def _offsets(near: np.ndarray) -> np.ndarray:
        """Offsets of (scored, window) positions; later ones are out of reach."""
        back = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)
        return np.where(back >= 0, near[np.abs(back)], -1e9).astype(np.float32)

    def spans(self, parts: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, ...]:
        """Training windows, one of each (ids, whether they open a text): inputs, targets, which are real, and which open a text."""
        n = len(parts)
        x, y, real = np.zeros((n, WINDOW), np.int64), np.zeros((n, SCORED), np.int64), np.zeros((n, SCORED), bool)
        opens = np.array([o for _, o in parts], bool)
        for i, (ids, o) in enumerate(parts):
            before = np.concatenate([np.full(CONTEXT + 1, self.end), ids]) if o else ids  # a text opens after an end
            x[i, : len(before) - 1] = before[:-1][:WINDOW]
            to = before[CONTEXT + 1 : WINDOW + 1]
            y[i, : len(to)], real[i, : len(to)] = to, True
        return self.row[x], self.class_of[y], real, opens

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, opens: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross-entropy of real targets y (outputs) after inputs x (rows), and its gradient by parameter."""
        loss, g, rows, e = self.sparse_gradients(x, y, real, opens)
        g["e"] = np.zeros_like(self.p["e"])
        g["e"][rows] = e
        return loss, g

    def sparse_gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, opens: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """As gradients(), but the embeddings' as the rows of x, in order, and the gradient of each.

        What depends on a row alone is computed once a row: its tables(). Parts of BATCH windows stay in the processor's cache.
        """
        p, many = self.p, np.float32(max(real.sum(), 1))
        met = x.ravel().astype(np.uint16)  # sorted by their digits
        order = np.argsort(met, kind="stable")
        met = met[order]
        new = np.append(True, met[1:] != met[:-1])
        starts, place = np.flatnonzero(new), np.empty(len(met), np.intp)
        rows = met[starts].astype(np.int64)
        place[order] = np.cumsum(new) - 1
        place, e = place.reshape(x.shape), p["e"][rows]
        scale = np.asarray(HEAD**-0.5, e.dtype)
        own, back = (*tables(p, e), e), np.concatenate([p["k"], p["v"], p["q"] * scale, p["o"][:WIDTH]], 1).T
        loss, offsets, de = 0.0, self._offsets(p["near"]), np.empty((*x.shape, WIDTH), e.dtype)
        room, wide = np.empty((BATCH * SCORED, OUTPUTS), e.dtype), np.zeros((BATCH, WINDOW, 3 * HEAD + OUTPUTS), e.dtype)
        g = {"out": np.zeros((HEAD, OUTPUTS), e.dtype), "near": np.zeros((SCORED, WINDOW)), "b": np.zeros(OUTPUTS, e.dtype), "wide": np.zeros((WIDTH, 3 * HEAD + OUTPUTS), e.dtype)}
        for i in range(0, len(x), BATCH):
            part = slice(i, i + BATCH)
            loss += self._part(g, de[part], own, back, offsets, place[part], y[part].ravel(), (real[part].ravel() / many).astype(e.dtype), opens[part], room, wide)
        gap = np.abs(np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW))
        reach = np.arange(CONTEXT, WINDOW)[:, None] >= np.arange(WINDOW)
        near = np.bincount(gap.ravel(), (g["near"] * reach).ravel(), WINDOW).astype(np.float32)
        k, v, q, o = np.split(g["wide"], [HEAD, 2 * HEAD, 3 * HEAD], 1)
        of = {"o": np.concatenate([o, g["out"]]), "b": g["b"], "near": near, "q": q * scale, "k": k, "v": v}
        return loss, of, rows, np.add.reduceat(de.reshape(-1, WIDTH).take(order, 0), starts, axis=0)

    def _part(self, g: dict[str, np.ndarray], de: np.ndarray, own: tuple[np.ndarray, ...], back: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, opens: np.ndarray, room: np.ndarray, wide: np.ndarray) -> float:
        """Adds the gradient of some windows to g and writes that by their inputs to de; their part of the loss.

        x: places in the tables own, whose last are the embeddings; wide: room for the gradients by
        place of keys, values, queries and what is added to outputs, of which back makes that of the embeddings.
        """
        n, out, asks, wide = len(y), self.p["o"][WIDTH:], x[:, CONTEXT:], wide[: len(x)]
        q, kv = own[0].take(asks, 0), own[1].take(x, 0)
        k, val = kv[:, :, :HEAD], kv[:, :, HEAD:]
        a, mixed = attended(q, k, val, offsets, opens)
        sums = mixed[:, :, -1:]
        h = (mixed[:, :, :-1] / sums).reshape(n, HEAD)
        z, exponent, total = outputs(h, out, own[2].take(asks.ravel(), 0), y, room)
        loss = float((np.log(total) - exponent) @ w)
        z.ravel()[np.arange(0, n * OUTPUTS, OUTPUTS) + y] -= total
        z *= (w / total)[:, None]
        g["out"] += crossed(h, z)
        g["b"] += np.ones(n, z.dtype) @ z
        dh = z @ out.T
        da = np.empty_like(mixed)  # of sums of a's rows that aren't divided yet; last, what the division takes off
        np.divide(dh.reshape(len(x), SCORED, HEAD), sums, out=da[:, :, :-1])
        np.divide(np.einsum("ij,ij->i", dh, -h).reshape(len(x), SCORED), sums[:, :, 0], out=da[:, :, -1])
        ds = da @ val.transpose(0, 2, 1)
        ds *= a
        g["near"] += ds.sum(0)
        np.matmul(ds.transpose(0, 2, 1), q, out=wide[:, :, :HEAD])
        np.matmul(a.transpose(0, 2, 1), da[:, :, :-1], out=wide[:, :, HEAD : 2 * HEAD])
        np.matmul(ds, k, out=wide[:, CONTEXT:, 2 * HEAD : 3 * HEAD])
        wide[:, CONTEXT:, 3 * HEAD :] = z.reshape(len(x), SCORED, OUTPUTS)
        flat = wide.reshape(-1, wide.shape[-1])
        g["wide"] += crossed(own[3].take(x.ravel(), 0), flat)
        np.matmul(flat, back, out=de.reshape(-1, WIDTH))
        return loss

    def open(self, rng: np.random.RandomState) -> None:
        """Random weights."""
        init = lambda *n, s=0.3: (rng.randn(*n) * s).astype(np.float32)
        self.p = {"e": init(ROWS + 1, WIDTH), "q": init(WIDTH, HEAD), "k": init(WIDTH, HEAD), "v": init(WIDTH, HEAD), "o": init(WIDTH + HEAD, OUTPUTS, s=0.1), "b": np.zeros(OUTPUTS, np.float32), "near": -0.1 * np.arange(WINDOW, dtype=np.float32)}

    def windows_of(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Training windows of the texts, as gradients() takes them; every token is the target of one."""
        inputs, targets, real, opens, _ = self._layout(texts)
        return [inputs, self.class_of[targets].astype(np.int32), real, opens]

    def begin(self, texts: list[np.ndarray], seed: int = 5) -> None:
        """Classes, and Adam from random weights on random windows of texts (arrays of ids, each with its end)."""
        self.cluster(np.bincount(self.contexts(texts), minlength=(ROWS + 1) * BEFORE))
        rng = np.random.RandomState(seed)
        self.open(rng)
        inputs, targets, real, opens, _ = self._layout(texts)
        targets, adam = self.class_of[targets], Adam(self.p)
        for step in range(STEPS):
            pick = rng.randint(0, len(inputs), WINDOWS)
            adam(self.gradients(inputs[pick], targets[pick], real[pick], opens[pick])[1], rate(step))

    @property
    def weights(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    @weights.setter
    def weights(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            size = self.p[k].size
            self.p[k] = flat[at : at + size].astype(np.float32).reshape(self.p[k].shape)
            at += size

    def finish(self) -> None:
        """Tables by row, for scoring."""
        self.tables, self.offsets, self.out = tables(self.p, self.p["e"]), self._offsets(self.p["near"]), self.p["o"][WIDTH:]

    def each(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each token of the texts (arrays of ids, each with its end), one after another: every token is scored in one window."""
        if not texts:
            return np.zeros(0)
        inputs, targets, real, opens, _ = self._layout(texts)
        asks, keys, base = self.tables
        out, room = [], np.empty((BATCH * SCORED, OUTPUTS), np.float32)
        for i in range(0, len(inputs), BATCH):
            x, y, kept = inputs[i : i + BATCH], targets[i : i + BATCH].ravel(), real[i : i + BATCH].ravel()
            before, key = x[:, CONTEXT:].ravel(), keys.take(x, 0)
            _, mixed = attended(asks.take(before, 0).reshape(len(x), SCORED, HEAD), key[:, :, :HEAD], key[:, :, HEAD:], self.offsets, opens[i : i + BATCH])
            h = (mixed[:, :, :-1] / mixed[:, :, -1:]).reshape(-1, HEAD)
            _, own, total = outputs(h, self.out, base.take(before, 0), self.class_of[y], room)
            out.append((own - np.log(total) + self.inside(y, before))[kept])
        return np.concatenate(out).astype(np.float64) / np.log(10)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), self.each(texts), len(texts))


class Adam:
    """Steps on the arrays of p, in place."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p, self.step = p, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def __call__(self, gradients: dict[str, np.ndarray], rate: float, rows: np.ndarray | None = None, each: np.ndarray | None = None) -> None:
        """A step; of the embeddings e, if rows are given, on those alone, by their gradients each."""
        self.step += 1
        for n, g in gradients.items():
            self._step(self.p[n], self.m[n], self.v[n], g, rate)
        if rows is not None:
            own = [x["e"].take(rows, 0) for x in (self.p, self.m, self.v)]
            self._step(*own, each, rate)
            for x, part in zip((self.p, self.m, self.v), own, strict=True):
                x["e"][rows] = part

    def _step(self, p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float) -> None:
        m *= 0.9
        m += (x := 0.1 * g)
        np.multiply(x, g, out=x)
        x *= 0.1
        v *= 0.99
        v += x
        np.multiply(v, 1 / (1 - 0.99**self.step), out=x)
        np.sqrt(x, out=x)
        x += 1e-6
        np.divide(m, x, out=x)
        x *= rate / (1 - 0.9**self.step)
        p -= x

    def learn(self, model: Attention, *batch: np.ndarray, rate: float) -> None:
        """A step of model, whose arrays these are, on windows as sparse_gradients() takes them."""
        _, g, rows, each = model.sparse_gradients(*batch)
        self(g, rate, rows, each)
