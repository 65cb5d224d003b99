"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Arrays are laid out features x batch, so that the gates of a step are contiguous blocks and one step is one matrix
product: its input is the last state over the character's embedding over a row of ones, and its rows are the four gates
and, for the state that went in, the CRF scores. Weights are trained by ``train_pii.py`` from labelled spans and kept in
one .npz file.
"""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "idnum", "address", "name")
#: O, then the B- and then the I- of each kind: the first FREE labels may follow any other.
LABELS = ("O", *(f"B-{k}" for k in KINDS), *(f"I-{k}" for k in KINDS))
FREE = 1 + len(KINDS)
_PLAIN = 128
#: Columns that are read together.
COLUMNS = 2048
#: Characters of windows that are read together at most.
READ = 10_000_000
#: Characters, with those that fill windows up to the longest, of windows that are decoded together.
CELLS = 131_072
#: Windows whose ends are read together.
PART = 16_384


def _char_table() -> np.ndarray:
    """Class of every code point below 0x3000: ASCII as it is but all digits as one, accented letters as their base
    letter, the rest by category. Class 0 pads."""
    table = np.full(0x3000, 127, np.int16)
    for c in range(0x3000):
        ch = chr(c)
        if c < 127:
            table[c] = 48 if ch.isdigit() else c if c >= 32 else (10 if ch in "\n\r" else 32 if ch == "\t" else 127)
        else:
            base = unicodedata.normalize("NFKD", ch)[:1]
            if base and base.isascii() and base.isprintable():
                table[c] = 48 if base.isdigit() else ord(base)
            elif ch.isspace():
                table[c] = 32
            elif ch.isalpha():
                table[c] = 1 if ch.islower() else 2
            elif ch in "‘’‚":
                table[c] = 39
            elif ch in "“”„":
                table[c] = 34
            elif ch in "‐‑–—":
                table[c] = 45
    return table


TABLE = _char_table().astype(np.uint8)


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(code, 0x2FFF)]


class BiLstmCrf:
    """Parameters by name: emb (classes x E); for each direction f, b: W* (4H x (H + E + 1)), gates in the order input,
    forget, output, cell; O* (K x H); c (K); CRF T (K x K) and start (K)."""

    def __init__(self, params: dict[str, np.ndarray]) -> None:
        self.p = {k: np.ascontiguousarray(v, np.float32) for k, v in params.items()}
        self.hidden, self.width = self.p["Wf"].shape[0] // 4, self.p["emb"].shape[1]

    @classmethod
    def fresh(cls, hidden: int, width: int = 8, seed: int = 0) -> BiLstmCrf:
        rng = np.random.default_rng(seed)
        k, h = len(LABELS), hidden
        p = {"emb": rng.normal(0, 0.7, (_PLAIN, width)), "c": np.zeros(k), "T": np.zeros((k, k)), "start": np.zeros(k)}
        for d in "fb":
            p["W" + d] = rng.normal(0, 1 / np.sqrt(h + width), (4 * h, h + width + 1))
            p["W" + d][:, -1] = 0
            p["W" + d][h : 2 * h, -1] = 1
            p["O" + d] = rng.normal(0, 1 / np.sqrt(2 * h), (k, h))
        return cls(p)

    @classmethod
    def load(cls, path: str) -> BiLstmCrf:
        with np.load(path) as f:
            return cls({k: f[k].astype(np.float32) for k in f.files})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """Embeddings (E, T, B) of class ids (T, B)."""
        out, x = np.empty((self.width, *x.shape), np.float32), x.astype(np.intp)
        for row, column in zip(np.ascontiguousarray(self.p["emb"].T), out):
            np.take(row, x, out=column, mode="clip")
        return out

    def _halved(self, d: str) -> np.ndarray:
        """Weights of a direction with the three sigmoid gates halved: sigmoid(z) is (tanh(z / 2) + 1) / 2, so one call
        of tanh serves all four gates."""
        w = self.p["W" + d].copy()
        w[: 3 * self.hidden] *= 0.5
        return w

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (T, K, B) of class ids (T, B)."""
        steps, batch = x.shape
        h, k = self.hidden, len(LABELS)
        inputs = self._inputs(x)
        scores = np.empty((steps, k, batch), np.float32)
        scores[:] = self.p["c"][:, None]
        th = np.empty((h, batch), np.float32)
        z = np.empty((4 * h + k, batch), np.float32)
        i, f, o, g, emitted = z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h : 4 * h], z[4 * h :]
        gates, sigmoids = z[: 4 * h], z[: 3 * h]
        for d in "fb":
            # The gates are kept as tanh(z / 2) + 1, twice the sigmoid; what is doubled so is halved in the weights that
            # read the state, and once in the cell.
            out = np.zeros((k, h + self.width + 1), np.float32)
            out[:, :h] = self.p["O" + d]
            w = np.concatenate([self._halved(d), out])
            w[:, :h] *= 0.5
            buffer = np.zeros((h + self.width + 1, batch), np.float32)
            buffer[-1] = 1
            state, fed, cell = buffer[:h], buffer[h:-1], np.zeros((h, batch), np.float32)
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            last = None
            for t in order:
                fed[:] = inputs[:, t]
                np.dot(w, buffer, out=z)
                if last is not None:
                    scores[last] += emitted
                last = t
                np.tanh(gates, out=gates)
                np.add(sigmoids, 1, out=sigmoids)
                np.multiply(cell, f, out=cell)
                np.multiply(i, g, out=i)
                np.add(cell, i, out=cell)
                np.multiply(cell, 0.5, out=cell)
                np.tanh(cell, out=th)
                np.multiply(o, th, out=state)
            if last is not None:
                scores[last] += (0.5 * self.p["O" + d]) @ state
        return scores

    def _read(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray, d: str) -> tuple[np.ndarray, np.ndarray]:
        """One direction over windows of class ids that lie in ``flat``, from their places ``first`` on; they are in the
        order of what is read. A beginning that windows have in common is read once. Scores (beginnings, K) and, for each
        place, the beginning that ends there."""
        h, k, step = self.hidden, len(LABELS), 1 if d == "f" else -1
        # Sigmoids are 1 / (1 + exp(-z)), tanh(z) is twice the sigmoid of 2z less 1. Cell and state are kept halved, so
        # that the factor of two is in the weights that read them.
        w = -self.p["W" + d]
        w[3 * h :] *= 2
        w[:, :h] *= 2
        out, emb = np.ascontiguousarray(2 * self.p["O" + d].T), np.ascontiguousarray(self.p["emb"].T)
        scores, node_at = np.empty((len(flat), k), np.float32), np.empty(len(flat), np.int32)  # unused rows take no memory
        rows = 2 * h + self.width + 1
        space, held = np.empty((rows + 7 * h) * COLUMNS, np.float32), np.empty((2, 2 * h * max(1, len(first))), np.float32)

        def step_on(old: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
            """Cells and states (2H, n) behind the characters ``code``, from columns ``before`` of the old ones."""
            n = len(code)
            x, rest = space[: rows * n].reshape(rows, n), space[rows * n : (rows + 7 * h) * n].reshape(7 * h, n)
            z, th, now = rest[: 4 * h], rest[4 * h : 5 * h], rest[5 * h :]
            np.take(old, before, axis=1, out=x[: 2 * h], mode="clip")
            np.take(emb, code, axis=1, out=x[2 * h : -1], mode="clip")
            x[-1] = 1
            np.dot(w, x[h:], out=z)
            np.exp(z, out=z)
            np.add(z, 1, out=z)
            np.divide(1, z, out=z)
            g, cell = z[3 * h :], now[:h]
            np.subtract(g, 0.5, out=g)
            np.multiply(g, z[:h], out=g)
            np.multiply(x[:h], z[h : 2 * h], out=cell)
            np.add(cell, g, out=cell)
            np.multiply(cell, -4, out=th)
            np.exp(th, out=th)
            np.add(th, 1, out=th)
            np.divide(1, th, out=th)
            np.subtract(th, 0.5, out=th)
            np.multiply(z[2 * h : 3 * h], th, out=now[h:])
            return now

        old, total, turn = np.zeros((2 * h, 1), np.float32), 0, 0
        some = np.flatnonzero(size)
        place, stop, at = first[some].astype(np.intp), (first + step * size)[some].astype(np.intp), np.zeros(len(some), np.intp)
        split = np.zeros(len(some), bool)
        split[:1] = True  # where a window differs from the one before it
        with np.errstate(over="ignore"):
            while len(place):
                code = np.take(flat, place)
                split[1:] |= code[1:] != code[:-1]
                heads = np.flatnonzero(split)
                count = len(heads)
                if count == len(place):
                    node, before = np.arange(count), at
                else:
                    node, before, code = np.cumsum(split) - 1, np.take(at, heads), np.take(code, heads)
                node_at[place] = node + total
                code, new = code.astype(np.intp), held[turn, : 2 * h * count].reshape(2 * h, count)
                for a in range(0, count, COLUMNS):
                    b = min(a + COLUMNS, count)
                    now = step_on(old, before[a:b], code[a:b])
                    new[:, a:b] = now
                    np.dot(now[h:].T, out, out=scores[total + a : total + b])
                old, at, total, turn = new, node, total + count, 1 - turn
                place += step
                going = place != stop
                on = np.flatnonzero(going)
                if len(on) < len(place):
                    split[1:] |= ~going[:-1]
                    place, stop, at, split = np.take(place, on), np.take(stop, on), np.take(at, on), np.take(split, on)
        return scores[:total], node_at

    def paths(self, windows: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Best label path of each window of class ids, as if it were read alone; windows share what they have in common
        at their beginnings, read forwards, and at their ends, read backwards."""
        size = np.array([len(x) for x in windows], np.int64)
        paths = [np.zeros(0, np.int8)] * len(windows)
        if not size.sum():
            return paths
        if size.sum() > READ and len(windows) > 1:  # memory follows what is read together
            half = min(max(1, int(np.searchsorted(np.cumsum(size), size.sum() // 2))), len(windows) - 1)
            return self.paths(windows[:half], batch) + self.paths(windows[half:], batch)
        flat = np.concatenate(windows)
        first = np.cumsum(size) - size
        whole, back = flat.tobytes(), flat[::-1].tobytes()
        n, ends = len(flat), (first + size).tolist()
        places = list(zip(first.tolist(), ends))
        ahead = np.array(sorted(range(len(windows)), key=lambda i: whole[places[i][0] : places[i][1]]))
        behind = np.array(sorted(range(len(windows)), key=lambda i: back[n - places[i][1] : n - places[i][0]]))
        forward, f_at = self._read(flat, first[ahead], size[ahead], "f")
        forward += self.p["c"]
        # What a group of windows needs lies in the same memory for each: new memory costs more than what is done in it.
        longest = int(size.max())
        places, numbers = np.empty((2, max(CELLS, longest)), np.intp)
        space = np.zeros((3, max(CELLS, longest) * len(LABELS)), np.float32)
        for a in range(0, len(behind), PART):
            part = behind[a : a + PART]
            backward, b_at = self._read(flat, (first + size - 1)[part], size[part], "b")
            part = part[np.argsort(size[part], kind="stable")]
            part = part[np.searchsorted(size[part], 1) :]
            c = 0
            while c < len(part):
                group = part[c : c + batch]
                group = group[: max(1, CELLS // int(size[group[-1]]))]
                c += len(group)
                shape = (int(size[group[-1]]), len(group), len(LABELS))
                cells = shape[0] * shape[1]
                at, number = places[:cells].reshape(shape[:2]), numbers[:cells].reshape(shape[:2])
                scores, more, best = (x[: cells * shape[2]] for x in space)
                np.minimum(np.arange(shape[0])[:, None], size[group] - 1, out=at)
                at += first[group]
                number[:] = f_at[at]
                np.take(forward, number, axis=0, out=scores.reshape(shape), mode="clip")
                number[:] = b_at[at]
                np.take(backward, number, axis=0, out=more.reshape(shape), mode="clip")
                scores += more
                scores = scores.reshape(shape).transpose(0, 2, 1)
                turned = more.reshape(scores.shape)
                turned[:] = scores
                found = np.ascontiguousarray(self.decode(turned, size[group], best.reshape(scores.shape)).T)
                for i, row, last in zip(group.tolist(), found, size[group].tolist()):
                    paths[i] = row[:last]
        return paths

    def decode(self, scores: np.ndarray, sizes: np.ndarray | None = None, best: np.ndarray | None = None) -> np.ndarray:
        """Best label path (T, B) of scores (T, K, B) under the CRF transitions. I-x follows only B-x and I-x, so a step
        is one sum and maximum over all labels for O and the B-, and one over two labels for each I-. With ``sizes``,
        which grow, column i ends after sizes[i] steps, and what its path has behind them means nothing. ``best`` is memory
        of the shape of the scores that is written over."""
        steps, k, batch = scores.shape
        sizes = np.full(batch, steps) if sizes is None else sizes
        live = np.searchsorted(sizes, np.arange(steps), "right").tolist()  # the first column that goes on at a step
        move = self.p["T"]
        free, turn, stay = move[:, :FREE, None], np.diag(move[1:FREE, FREE:])[:, None], np.diag(move[FREE:, FREE:])[:, None]
        best = np.zeros((steps, k, batch), np.float32) if best is None else best
        best[0] = scores[0] + (self.p["start"] + np.r_[np.zeros(FREE), np.full(k - FREE, -1e4)].astype(np.float32))[:, None]
        sums = np.empty((k, FREE, batch), np.float32)
        plain = np.ones(batch, bool)
        for t in range(1, steps):
            lo = live[t]
            last, now = best[t - 1, :, lo:], best[t, :, lo:]
            into = sums[:, :, lo:]
            np.add(last[:, None, :], free, out=into)
            np.max(into, axis=0, out=now[:FREE])
            np.maximum(last[1:FREE] + turn, last[FREE:] + stay, out=now[FREE:])
            plain[lo:] &= into[0, 0] == now[0]  # O comes from O
            now += scores[t, :, lo:]
        path = np.zeros((steps, batch), np.int8)
        end = best[sizes - 1, :, np.arange(batch)].argmax(1)
        some = np.flatnonzero(~plain | (end > 0))  # all other paths are O throughout
        if len(some):
            # Which label came before is looked up on the way back, for the labels of the path alone.
            into, at, size = np.ascontiguousarray((move + _FORBIDDEN).T), end[some], sizes[some]
            path[-1, some] = at
            held = best[:, :, some]
            for t in range(steps - 1, 0, -1):
                at = np.where(t < size, (held[t - 1] + into[at].T).argmax(0), at)
                path[t - 1, some] = at
        return path

    # -- training ---------------------------------------------------------------------------------------------------

    def _forward(self, inputs: np.ndarray, d: str, keep: list) -> np.ndarray:
        """States (T, H, B) of one direction; what the way back needs goes to ``keep``."""
        _, steps, batch = inputs.shape
        h, w = self.hidden, self._halved(d)
        out = np.empty((steps, h, batch), np.float32)
        state, cell = np.zeros((h, batch), np.float32), np.zeros((h, batch), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            fed = np.concatenate([state, inputs[:, t], np.ones((1, batch), np.float32)])
            z = np.tanh(w @ fed)
            z[: 3 * h] = z[: 3 * h] * 0.5 + 0.5
            now = z[h : 2 * h] * cell + z[:h] * z[3 * h :]
            th = np.tanh(now)
            keep.append((t, fed, z, cell, th))
            cell, state = now, z[2 * h : 3 * h] * th
            out[t] = state
        return out

    def loss_and_grads(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF loss per position over windows (T, B) with labels, and its gradients."""
        steps, batch = x.shape
        h, k = self.hidden, len(LABELS)
        inputs = self._inputs(x)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._forward(inputs, d, kept[d]) for d in "fb"}
        scores = self.p["Of"] @ states["f"] + self.p["Ob"] @ states["b"] + self.p["c"][:, None]
        move, start = self.p["T"], self.p["start"]
        alpha, beta = np.empty((steps, k, batch), np.float32), np.zeros((steps, k, batch), np.float32)
        alpha[0] = scores[0] + start[:, None]
        gain = np.exp(move)
        for t in range(1, steps):
            m = alpha[t - 1].max(0)
            alpha[t] = scores[t] + m + np.log(gain.T @ np.exp(alpha[t - 1] - m) + 1e-30)
        m = alpha[-1].max(0)
        z = m + np.log(np.exp(alpha[-1] - m).sum(0))
        for t in range(steps - 2, -1, -1):
            ahead = scores[t + 1] + beta[t + 1]
            m = ahead.max(0)
            beta[t] = m + np.log(gain @ np.exp(ahead - m) + 1e-30)
        rows = np.arange(batch)
        y = y.astype(np.int64)
        at = np.take_along_axis(scores, y[:, None, :], 1)[:, 0]
        gold = at.sum(0) + start[y[0]] + move[y[:-1], y[1:]].sum(0)
        norm = steps * batch
        loss = float((z - gold).sum() / norm)
        d_scores = np.exp(alpha + beta - z)
        # exp(alpha + move + score + beta - z) summed over places and batch, scaled per column.
        ahead = scores[1:] + beta[1:]
        low, high = alpha[:-1].max(1, keepdims=True), ahead.max(1, keepdims=True)
        left = np.exp(alpha[:-1] - low + (low + high - z)).transpose(1, 0, 2).reshape(k, -1)
        right = np.exp(ahead - high).transpose(1, 0, 2).reshape(k, -1)
        d_move = (left @ right.T) * gain
        np.add.at(d_move, (y[:-1].ravel(), y[1:].ravel()), -1)
        d_start = d_scores[0].sum(1)
        np.add.at(d_start, y[0], -1)
        d_scores[np.arange(steps)[:, None], y, rows[None, :]] -= 1
        d_scores /= norm
        grads = {"T": d_move / norm, "start": d_start / norm, "c": d_scores.sum((0, 2))}
        d_inputs = np.zeros_like(inputs)
        for d in "fb":
            grads["O" + d] = np.einsum("tkb,thb->kh", d_scores, states[d], optimize=True)
            dh = self.p["O" + d].T @ d_scores
            w, g_w = self.p["W" + d], np.zeros_like(self.p["W" + d])
            back = np.ascontiguousarray(w[:, :-1].T)
            d_state, d_cell = np.zeros((h, batch), np.float32), np.zeros((h, batch), np.float32)
            dz = np.empty((4 * h, batch), np.float32)
            for t, fed, gates, cell, th in reversed(kept[d]):
                i, f, o, g = gates[:h], gates[h : 2 * h], gates[2 * h : 3 * h], gates[3 * h :]
                ds = dh[t] + d_state
                dc = d_cell + ds * o * (1 - th * th)
                dz[:h], dz[h : 2 * h], dz[2 * h : 3 * h], dz[3 * h :] = dc * g, dc * cell, ds * th, dc * i * (1 - g * g)
                dz[: 3 * h] *= gates[: 3 * h] * (1 - gates[: 3 * h])
                g_w += dz @ fed.T
                below = back @ dz
                d_state, d_cell = below[:h], dc * f
                d_inputs[:, t] += below[h:]
            grads["W" + d] = g_w
        seen = np.argsort(x.ravel(), kind="stable")
        ids, firsts = np.unique(x.ravel()[seen], return_index=True)
        grads["emb"] = np.zeros_like(self.p["emb"])
        grads["emb"][ids] = np.add.reduceat(d_inputs.reshape(self.width, -1)[:, seen], firsts, axis=1).T
        return loss, grads


def _constraints() -> np.ndarray:
    """I-x may follow only B-x or I-x."""
    k = len(LABELS)
    no = np.zeros((k, k), np.float32)
    for b, lb in enumerate(LABELS):
        if lb[0] == "I":
            for a, la in enumerate(LABELS):
                if la[2:] != lb[2:] or la == "O":
                    no[a, b] = -1e4
    return no


_FORBIDDEN = _constraints()
