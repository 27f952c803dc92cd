"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by back-propagation, decoding of whole texts.

Tags are O and, for each kind, B (first character of a span) and I (the rest). Gates and cells are squashed by softsign,
x / (1 + |x|), which costs a tenth of tanh here. Texts are read in windows of CORE characters with CONTEXT more on both
sides; a character's emissions come from the window that has it in its core, so the windows of a text make one row of
emissions, and the CRF's best path is taken over all of it: spans may be of any length and cross any number of windows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Characters: ASCII with letters folded, one class for other letters, one for all else, one for padding.
CLASSES = 131
_OTHER_LETTER, _OTHER, PAD = 128, 129, 130
CORE, CONTEXT = 480, 32
#: Windows that are read at a time: many, since each step of time costs some 20 calls.
BATCH = 4096
_SHUT = np.float32(-1e9)


def encode(text: str) -> np.ndarray:
    """Character classes of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 128, points, _OTHER).astype(np.int64)
    out[(points >= 65) & (points <= 90)] += 32
    out[(points >= 0xC0) & (points < 0x2000)] = _OTHER_LETTER
    return out


def _softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


@dataclass
class Tagger:
    kinds: int
    p: dict[str, np.ndarray]

    @property
    def tags(self) -> int:
        return 1 + 2 * self.kinds

    @staticmethod
    def new(kinds: int, size: int = 12, hidden: int = 8, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        f32 = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        p = {"emb": f32(CLASSES, size) * 12, "out": f32(2 * hidden, 1 + 2 * kinds), "out_b": np.zeros(1 + 2 * kinds, np.float32), "trans": np.zeros((1 + 2 * kinds,) * 2, np.float32)}
        for d in "lr":
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden : 2 * hidden] = 1
            p |= {f"x{d}": f32(size, 4 * hidden) * 2, f"h{d}": f32(hidden, 4 * hidden) * 2, f"b{d}": bias}
        return Tagger(kinds, p)

    # --- training -----------------------------------------------------------------------------------------------

    def _lstm(self, x: np.ndarray, shut: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states (2, T, B, H) of both directions over x (T, B, E), each in its own order of time, and what the backward pass needs; padding (``shut``) leaves a state at zero."""
        n = self.p["hl"].shape[0]
        w = np.stack([x @ self.p["xl"] + self.p["bl"], (x @ self.p["xr"] + self.p["br"])[::-1]])
        w[0, shut, :n] = _SHUT
        w[1, shut[::-1], :n] = _SHUT
        hw = np.stack([self.p["hl"], self.p["hr"]])
        h = c = np.zeros((2, x.shape[1], n), x.dtype)
        out, kept = np.empty((2, *x.shape[:2], n), x.dtype), []
        for t in range(len(x)):
            s = _softsign(w[:, t] + h @ hw)
            ifo, u = 0.5 * s[..., : 3 * n] + np.float32(0.5), s[..., 3 * n :]
            before_h, before_c = h, c
            c = ifo[..., n : 2 * n] * c + ifo[..., :n] * u
            tc = _softsign(c)
            h = ifo[..., 2 * n :] * tc
            out[:, t] = h
            kept.append((s, ifo, before_c, tc, before_h))
        return out, kept

    def _lstm_back(self, x: np.ndarray, shut: np.ndarray, kept: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> np.ndarray:
        hw = np.stack([self.p["hl"], self.p["hr"]])
        n = hw.shape[1]
        back = hw.transpose(0, 2, 1)
        dg_all = np.zeros((2, *x.shape[:2], 4 * n), x.dtype)
        dh = dc = np.zeros((2, x.shape[1], n), x.dtype)
        states = np.stack([k[4] for k in kept], axis=1)
        for t in range(len(x) - 1, -1, -1):
            s, ifo, before_c, tc, _ = kept[t]
            dh = dh + dout[:, t]
            dc = dc + dh * ifo[..., 2 * n :] * (1 - np.abs(tc)) ** 2
            slope = (1 - np.abs(s)) ** 2
            slope[..., : 3 * n] *= 0.5
            dg = np.concatenate([dc * s[..., 3 * n :], dc * before_c, dh * tc, dc * ifo[..., :n]], axis=2) * slope
            dg_all[:, t] = dg
            dh, dc = dg @ back, dc * ifo[..., n : 2 * n]
        dx = np.zeros_like(x)
        for i, d in enumerate("lr"):
            grad[f"h{d}"] = np.tensordot(states[i], dg_all[i], ([0, 1], [0, 1]))
            own = dg_all[i] if d == "l" else dg_all[i][::-1]
            own[shut, :n] = 0
            grad[f"x{d}"], grad[f"b{d}"] = np.tensordot(x, own, ([0, 1], [0, 1])), own.sum(axis=(0, 1))
            dx += own @ self.p[f"x{d}"].T
        return dx

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags gold (B, T) and its gradients."""
        x, y, shut = self.p["emb"][codes.T], gold.T, codes.T == PAD
        steps, batch = y.shape
        states, kept = self._lstm(x, shut)
        both = np.concatenate([states[0], states[1][::-1]], axis=2)
        e, trans = both @ self.p["out"] + self.p["out_b"], self.p["trans"]
        # forward and backward sums as products with exp(transitions), each row scaled by its largest term
        link = np.exp(trans)
        a, b = np.empty_like(e), np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            top = a[t - 1].max(axis=1, keepdims=True)
            a[t] = e[t] + np.log(np.exp(a[t - 1] - top) @ link) + top
        total = _logsum(a[-1], 1)
        for t in range(steps - 2, -1, -1):
            ahead = e[t + 1] + b[t + 1]
            top = ahead.max(axis=1, keepdims=True)
            b[t] = np.log(np.exp(ahead - top) @ link.T) + top
        ahead = (e + b)[1:]
        top_a, top_b = a[:-1].max(axis=2, keepdims=True), ahead.max(axis=2, keepdims=True)
        dtrans = link * np.tensordot(np.exp(a[:-1] - top_a) * np.exp(top_a + top_b - total[:, None]), np.exp(ahead - top_b), ([0, 1], [0, 1]))
        de = np.exp(a + b - total[None, :, None])
        at = np.arange(batch)
        score = sum(e[t, at, y[t]] for t in range(steps)) + sum(trans[y[t], y[t + 1]] for t in range(steps - 1))
        for t in range(steps):
            de[t, at, y[t]] -= 1
        np.subtract.at(dtrans, (y[:-1].ravel(), y[1:].ravel()), 1)
        de /= batch
        grad = {"trans": dtrans / batch, "out": np.tensordot(both, de, ([0, 1], [0, 1])), "out_b": de.sum(axis=(0, 1))}
        dboth = de @ self.p["out"].T
        n = states.shape[3]
        dx = self._lstm_back(x, shut, kept, np.stack([dboth[:, :, :n], dboth[::-1, :, n:]]), grad)
        grad["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(grad["emb"], codes.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((total - score).mean()), grad

    def fit(self, codes: np.ndarray, gold: np.ndarray, steps: int, batch: int = 48, rate: float = 0.05, seed: int = 5) -> float:
        """Adam over ``steps`` random batches; the last losses' mean."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(codes), batch)
            loss, grad = self.gradients(codes[at], gold[at])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            own, clip = rate * (1 - 0.9 * step / steps), np.float32(min(1.0, 20.0 / (norm + 1e-9)))
            for k, g in grad.items():
                g = g * clip
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.99 * v2[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - own * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-20:])) if losses else 0.0

    # --- reading ------------------------------------------------------------------------------------------------

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(T, tags, B) of windows codes (T, B), padded at their ends; a padded window gives what it would give alone."""
        steps, batch = codes.shape
        out = np.empty((steps, self.tags, batch), np.float32)
        n = self.p["hl"].shape[0]
        own, more, tc = np.empty((batch, 4 * n), np.float32), np.empty((4 * n, batch), np.float32), np.empty((n, batch), np.float32)
        size, part = np.empty_like(more), np.empty((self.tags, batch), np.float32)
        for d in "lr":
            table = self.p["emb"] @ self.p[f"x{d}"] + self.p[f"b{d}"]  # what each character class gives the gates
            table[PAD, :n] = _SHUT
            hw, wo = np.ascontiguousarray(self.p[f"h{d}"].T), np.ascontiguousarray((self.p["out"][:n] if d == "l" else self.p["out"][n:]).T)
            h, c = np.zeros((n, batch), np.float32), np.zeros((n, batch), np.float32)
            for t in range(steps) if d == "l" else range(steps - 1, -1, -1):
                np.take(table, codes[t], axis=0, out=own, mode="clip")
                np.matmul(hw, h, out=more)
                more += own.T
                np.abs(more, out=size)
                size += 1
                more /= size
                gates = more[: 3 * n]
                gates *= 0.5
                gates += 0.5
                c *= gates[n : 2 * n]
                np.multiply(gates[:n], more[3 * n :], out=tc)
                c += tc
                np.abs(c, out=tc)
                tc += 1
                np.divide(c, tc, out=tc)
                np.multiply(gates[2 * n :], tc, out=h)
                if d == "l":
                    np.matmul(wo, h, out=out[t])
                else:
                    np.matmul(wo, h, out=part)
                    out[t] += part
        out += self.p["out_b"][:, None]
        return out

    def transitions(self) -> np.ndarray:
        """The CRF's transitions; I follows only B or I of its kind, and B only O: spans don't touch."""
        trans = self.p["trans"].astype(np.float64)
        for k in range(self.kinds):
            trans[[t for t in range(self.tags) if t not in (1 + 2 * k, 2 + 2 * k)], 2 + 2 * k] = -1e9
        trans[1:, 1::2] = -1e9
        return trans

    def whole_emissions(self, texts: list[np.ndarray], begins: np.ndarray, places: int) -> np.ndarray:
        """(tags, places): every text's emissions from its place ``begins`` on; 0 at places of no text."""
        lengths = np.array([len(x) for x in texts], np.int64)
        flat = np.full(places, PAD, np.int64)
        for x, at in zip(texts, begins.tolist(), strict=True):
            flat[at : at + len(x)] = x
        windows = -(-lengths // CORE)
        of = np.repeat(np.arange(len(texts)), windows)
        core = (np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)) * CORE
        core_end = np.minimum(core + CORE, lengths[of])
        low, high = np.maximum(0, core - CONTEXT), np.minimum(lengths[of], core_end + CONTEXT)
        out = np.zeros((self.tags, places), np.float32)
        order = np.argsort(low - high, kind="stable")
        length = (high - low)[order]
        i = 0
        while i < len(order):
            # windows of at least half the longest one's length together
            n = min(BATCH, int(np.searchsorted(-length[i:], -(length[i] // 2), "right")))
            own = order[i : i + n]
            i += n
            time = np.arange(int((high[own] - low[own]).max()))[:, None]
            e = self.emissions(np.where(time < high[own] - low[own], flat[np.minimum(begins[of[own]] + low[own] + time, places - 1)], PAD))
            turned = np.empty((self.tags, len(own), len(time)), np.float32)
            for tag in range(self.tags):
                turned[tag] = e[:, tag].T
            for j, (a, b, first, at) in enumerate(zip(core[own].tolist(), core_end[own].tolist(), low[own].tolist(), begins[of[own]].tolist(), strict=True)):
                out[:, at + a : at + b] = turned[:, j, a - first : b - first]
        return out

    def spans(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, margin) of the spans on the best path of each text (given as classes); the margin is how much the path loses without the span.

        Spans don't touch, so a path is O and spans that each bring a gain of their own over O. A character that no span of a
        gain of 0 or more covers is O on the best path; running maxima find these, and the stretches between them have best
        paths of their own."""
        lengths = np.array([len(x) for x in texts], np.int64)
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        if not lengths.sum():
            return found
        begins = np.cumsum(lengths + 1) - lengths  # a place between texts, where no span can be
        places = int(lengths.sum()) + len(texts) + 1
        e = self.whole_emissions(texts, begins, places)
        some = lengths > 0
        text_first, text_last = begins[some], begins[some] + lengths[some] - 1
        between = np.ones(places, bool)
        between[np.concatenate([np.arange(a, b + 1) for a, b in zip(text_first, text_last, strict=True)])] = False
        trans = self.transitions()
        live = np.zeros(places, bool)
        for k in range(self.kinds):
            b_tag, i_tag = 1 + 2 * k, 2 + 2 * k
            gain = lambda x, y: trans[x, y] - trans[0, 0]  # noqa: B023, E731
            begin = (e[b_tag] - e[0]).astype(np.float64)
            begin += gain(0, b_tag)
            begin[text_first] -= gain(0, b_tag)
            begin[between] = -1e6
            inner = (e[i_tag] - e[0]).astype(np.float64)
            inner += gain(i_tag, i_tag)
            inner[between] = -1e6
            total = np.cumsum(inner)
            out_of = np.full(places, gain(i_tag, 0))
            out_of[text_last] = 0.0
            alone = begin + gain(b_tag, 0)
            alone[text_last] -= gain(b_tag, 0)
            # a span of [a, b) with more than one character gains opened[a] + closed[b - 1]
            opened = begin + (gain(b_tag, i_tag) - gain(i_tag, i_tag)) - total
            closed = total + out_of
            best_opened, best_closed = np.maximum.accumulate(opened), np.maximum.accumulate(closed[::-1])[::-1]
            live |= alone >= -1e-6
            live[1:] |= best_opened[:-1] + best_closed[1:] >= -1e-6
            live[:-1] |= opened[:-1] + best_closed[1:] >= -1e-6
        live[between] = False
        at = np.flatnonzero(live)
        if not len(at):
            return found
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        text = np.searchsorted(begins, at[starts], "right") - 1
        opens, closes = at[starts] == begins[text], at[ends - 1] == begins[text] + lengths[text] - 1
        own = e[:, at].T.astype(np.float64)
        for s, tags in self.best_paths(own, starts, ends, opens, closes):
            for k, a, b in tag_spans(tags):
                margin = self._margin(own[starts[s] : ends[s]], tags, a, b, trans, bool(opens[s]), bool(closes[s]))
                first = int(at[starts[s]] - begins[text[s]])
                found[text[s]].append((k, first + a, first + b, margin))
        return [sorted(x, key=lambda y: y[1]) for x in found]

    @staticmethod
    def _margin(e: np.ndarray, tags: np.ndarray, a: int, b: int, trans: np.ndarray, opens: bool, closes: bool) -> float:
        """What the path's score loses if the span [a, b) becomes O."""
        own = tags[a:b]
        gained = float((e[np.arange(a, b), own] - e[a:b, 0]).sum()) + float((trans[own[:-1], own[1:]] - trans[0, 0]).sum())
        gained += 0.0 if a == 0 and opens else float(trans[0, own[0]] - trans[0, 0])
        return gained + (0.0 if b == len(tags) and closes else float(trans[own[-1], 0] - trans[0, 0]))

    def best_paths(self, e: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray, closes: np.ndarray):  # noqa: ANN201
        """(number, tags) of each stretch's best path; a stretch has O before it unless it ``opens`` its text, and O behind it unless it ``closes`` it."""
        trans = self.transitions()
        first = np.where((np.arange(self.tags) % 2 == 1) | (np.arange(self.tags) == 0), 0.0, -1e9)  # no text begins inside a span
        lengths = ends - starts
        order = np.argsort(lengths, kind="stable")
        done = 0
        while done < len(order):
            # stretches of like length together; at most about a million places at a time
            most = max(8, 2 * int(lengths[order[done]]))
            n = min(int(np.searchsorted(lengths[order], most, "right")) - done, max(1, (1 << 20) // most))
            own = order[done : done + n]
            done += n
            steps = int(lengths[own].max())
            best = e[starts[own]] + np.where(opens[own][:, None], first, trans[0])
            back = np.zeros((steps, len(own), self.tags), np.int8)
            for t in range(1, steps):
                open_ = np.flatnonzero(lengths[own] > t)
                s = best[open_][:, :, None] + trans[None]
                back[t, open_] = s.argmax(axis=1)
                best[open_] = s.max(axis=1) + e[starts[own[open_]] + t]
            last = (best + np.where(closes[own][:, None], 0.0, trans[:, 0])).argmax(axis=1)
            tags = np.zeros((len(own), steps), np.int64)
            for t in range(steps - 1, -1, -1):
                here = lengths[own] - 1 >= t
                last = np.where(lengths[own] - 1 > t, back[min(t + 1, steps - 1), np.arange(len(own)), last], last)
                tags[here, t] = last[here]
            for i, s in enumerate(own.tolist()):
                if tags[i].any():
                    yield s, tags[i, : lengths[s]]


def tag_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans of a row of tags."""
    out = []
    for s in np.flatnonzero(tags % 2 == 1).tolist():
        inner = tags[s + 1 :] == tags[s] + 1
        out.append((int(tags[s] - 1) // 2, s, s + 1 + (len(inner) if inner.all() else int(np.argmin(inner)))))
    return out
