"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Size of the state, words of a class, and their classes; a model of other sizes is another model.
HIDDEN, CLASS_WORDS, HEAD_CLASSES, TAIL_CLASSES = 16, 64, 32, 32
HEAD = CLASS_WORDS * HEAD_CLASSES
#: Token 0 ends a document and stands before each one.
END = 0
#: Steps of one window; gradients end at its beginning, the state goes on.
WINDOW = 20
#: Documents that are read side by side at most.
LANES = 512
RATE = 0.08
UNUSED = -30.0

Params = dict[str, np.ndarray]


def start_model(head_counts: np.ndarray, tail_mass: np.ndarray, seed: int = 7) -> Params:
    """Small random weights; biases give every token its share in the corpus."""
    rng = np.random.default_rng(seed)

    def small(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    counts = np.zeros(HEAD)
    counts[: len(head_counts)] = head_counts
    mass = np.concatenate([counts.reshape(HEAD_CLASSES, CLASS_WORDS).sum(1), tail_mass]) + 0.1
    word = np.where(np.arange(HEAD) < len(head_counts), np.log(counts + 0.1), UNUSED)
    return {
        "input": small(HEAD + TAIL_CLASSES, 3 * HIDDEN),
        "state": small(HIDDEN, 3 * HIDDEN),
        "classes": small(HIDDEN, HEAD_CLASSES + TAIL_CLASSES),
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "words": small(HIDDEN, HEAD),
        "word_bias": word.astype(np.float32),
    }


def class_of(tokens: np.ndarray) -> np.ndarray:
    return np.where(tokens < HEAD, tokens // CLASS_WORDS, tokens - HEAD + HEAD_CLASSES)


def states(model: Params, tokens: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
    """States (steps x lanes x size) after each of ``tokens`` (steps x lanes), and the last as size x lanes.

    Begins with ``h``, size x lanes; a fresh lane begins with zeros. With
    ``keep`` also what the backward pass needs. Steps work on columns, one for
    each lane, and stay in the processor's cache.
    """
    n, (steps, lanes) = HIDDEN, tokens.shape
    weights = np.ascontiguousarray(model["state"].T)
    out = np.empty((steps, lanes, n), h.dtype)
    kept = steps if keep else 1
    before, own, gate, new = (np.empty((kept, rows, lanes), h.dtype) for rows in (n, 3 * n, 2 * n, n))
    any_fresh = fresh.any(axis=1)
    for t in range(steps):
        k = t if keep else 0
        b, o, gates, x = before[k], own[k], gate[k], new[k]
        b[:] = h
        if any_fresh[t]:
            b[:, fresh[t]] = 0
        given = np.take(model["input"], tokens[t], axis=0).T
        np.matmul(weights, b, out=o)
        np.add(given[: 2 * n], o[: 2 * n], out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        np.multiply(gates[n:], o[2 * n :], out=x)
        x += given[2 * n :]
        np.tanh(x, out=x)
        h = b - x
        h *= gates[:n]
        h += x
        out[t] = h.T
    return (out, h, (before, gate, own[:, 2 * n :], new)) if keep else (out, h)


#: Tokens whose logits are held at once.
COLUMNS = 1024


def logits(weights: np.ndarray, bias: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Logits less their largest, a column for each row of ``h``."""
    x = weights.T @ h.T
    x += bias[:, None]
    x -= x.max(axis=0)
    return x


def outputs(weights: np.ndarray, bias: np.ndarray, h: np.ndarray, wanted: np.ndarray, into: tuple | None = None) -> np.ndarray:
    """Log probability of each row's wanted output.

    ``into`` has arrays that gradients are added to: of weights, bias and ``h``.
    """
    logs = np.empty(len(wanted))
    for begin in range(0, len(wanted), COLUMNS):
        part = h[begin : begin + COLUMNS]
        x, want = logits(weights, bias, part), wanted[begin : begin + COLUMNS]
        at = (want, np.arange(len(want)))
        own = x[at]
        np.exp(x, out=x)
        total = x.sum(axis=0)
        logs[begin : begin + COLUMNS] = own - np.log(total)
        if into is not None:
            x /= total
            x[at] -= 1
            into[0][:] += (x @ part).T
            into[1][:] += x.sum(axis=1)
            into[2][begin : begin + COLUMNS] += x.T @ weights.T
    return logs


def by_class(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Classes of head tokens and the places of their tokens."""
    head = np.flatnonzero(tokens < HEAD)
    classes = (tokens[head] // CLASS_WORDS).astype(np.uint8)
    order = head[np.argsort(classes, kind="stable")]
    ends = np.cumsum(np.bincount(classes, minlength=HEAD_CLASSES))
    for c, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)):
        if end > begin:
            yield c, order[begin:end]


def own_words(c: int) -> slice:
    return slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)


def token_logs(model: Params, h: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probabilities of tokens after states: their class, and for head words the word in its class."""
    out = outputs(model["classes"], model["class_bias"], h, class_of(tokens))
    for c, at in by_class(tokens):
        own = own_words(c)
        out[at] += outputs(model["words"][:, own], model["word_bias"][own], h[at], tokens[at] - own.start)
    return out


def gradients(model: Params, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray):
    """Summed gradients of the window's negative log probability, the state after it, and the loss."""
    n, (steps, lanes) = HIDDEN, inputs.shape
    out, last, (before, gates, own, new) = states(model, inputs, fresh, h, keep=True)
    rows = out.reshape(-1, n)
    at = np.flatnonzero(valid)
    whole = len(at) == len(rows)
    flat, want = rows if whole else rows[at], targets.reshape(-1)[at]
    grad = {name: np.zeros_like(value) for name, value in model.items()}
    dflat = np.zeros_like(flat)
    loss = -outputs(model["classes"], model["class_bias"], flat, class_of(want), (grad["classes"], grad["class_bias"], dflat)).sum()
    for c, those in by_class(want):
        words = own_words(c)
        d = np.zeros((len(those), n), h.dtype)
        into = (grad["words"][:, words], grad["word_bias"][words], d)
        loss -= outputs(model["words"][:, words], model["word_bias"][words], flat[those], want[those] - words.start, into).sum()
        dflat[those] += d
    if not whole:
        rows[:] = 0
        rows[at] = dflat
        dflat = rows
    dout = dflat.reshape(steps, lanes, n)
    by_token = np.empty((steps, lanes, 3 * n), h.dtype)
    dgiven, down = (np.empty((3 * n, lanes), h.dtype) for _ in range(2))
    dh = np.zeros((n, lanes), h.dtype)
    for t in range(steps - 1, -1, -1):
        z, r = gates[t, :n], gates[t, n:]
        dh += dout[t].T
        dz, dr, dx = dgiven[:n], dgiven[n : 2 * n], dgiven[2 * n :]
        np.subtract(before[t], new[t], out=dz)
        dz *= dh
        keep = dh * z
        np.subtract(dh, keep, out=dx)
        dz *= z
        dz *= 1 - z
        dx *= 1 - new[t] * new[t]
        np.multiply(dx, own[t], out=dr)
        dr *= r
        dr *= 1 - r
        down[: 2 * n] = dgiven[: 2 * n]
        np.multiply(dx, r, out=down[2 * n :])
        dh = model["state"] @ down
        dh += keep
        grad["state"] += before[t] @ down.T
        by_token[t] = dgiven.T
        if fresh[t].any():
            dh[:, fresh[t]] = 0
    flat_in = inputs.reshape(-1)
    order = np.argsort(flat_in.astype(np.uint16), kind="stable")
    begins = np.flatnonzero(np.diff(flat_in[order], prepend=-1))
    sorted_rows = np.take(by_token.reshape(-1, 3 * n), order, axis=0)
    grad["input"][flat_in[order[begins]]] = np.add.reduceat(sorted_rows, begins, axis=0)
    return grad, last, float(loss)


class Trainer:
    """Adaptive gradient steps on a copy of the model; ``squares`` go with the model from task to task."""

    def __init__(self, model: Params, squares: Params):
        self.model = {name: value.copy() for name, value in model.items()}
        self.squares = {name: value.copy() for name, value in squares.items()}
        self.tokens, self.loss = 0, 0.0

    def read(self, ids: np.ndarray, fresh: np.ndarray) -> None:
        """Learns from documents in a row, cut into lanes of equal length that are read side by side.

        ``fresh`` marks the first token of each document. Lanes number such that
        there are some 60 steps or more, and 8 to 512.
        """
        lanes = int(np.clip(len(ids) // (WINDOW * 60), 8, LANES))
        length = -(-len(ids) // lanes)
        pad = lanes * length - len(ids)
        targets = np.pad(ids.astype(np.int32), (0, pad)).reshape(lanes, length).T
        before = np.pad(ids.astype(np.int32)[:-1], (1, pad), constant_values=END).reshape(lanes, length).T
        fresh = np.pad(fresh, (0, pad)).reshape(lanes, length).T
        valid = (np.arange(lanes * length) < len(ids)).reshape(lanes, length).T
        inputs = np.where(fresh, END, before)
        h = np.zeros((HIDDEN, lanes), np.float32)
        for t in range(0, length, WINDOW):
            part = slice(t, t + WINDOW)
            if not valid[part].any():
                break
            grad, h, loss = gradients(self.model, inputs[part], targets[part], fresh[part], valid[part], h)
            n = int(valid[part].sum())
            self.tokens, self.loss = self.tokens + n, self.loss + loss
            for name, g in grad.items():
                g *= np.float32(1 / n)
                self.squares[name] += g * g
                self.model[name] -= np.float32(RATE) * g / (np.sqrt(self.squares[name]) + np.float32(1e-6))


def start_squares(model: Params) -> Params:
    return {name: np.full_like(value, 1e-7) for name, value in model.items()}


def document_logs(model: Params, ids: np.ndarray, offsets: np.ndarray, lanes: int = LANES // 2) -> np.ndarray:
    """Each document's log probability; the state goes from window to window until its end.

    Documents are dealt to lanes, long ones first, each to the shortest lane;
    lanes that have ended are left out of the following windows.
    """
    import heapq

    sizes = np.diff(offsets)
    todo = np.argsort(-sizes, kind="stable")
    todo = todo[sizes[todo] > 0]
    out = np.zeros(len(sizes))
    if not len(todo):
        return out
    heap = [(0, lane) for lane in range(min(lanes, len(todo)))]
    dealt: list[list[int]] = [[] for _ in heap]
    for doc in todo.tolist():
        load, lane = heapq.heappop(heap)
        dealt[lane].append(doc)
        heapq.heappush(heap, (load + int(sizes[doc]), lane))
    loads = np.array([int(sizes[docs].sum()) for docs in dealt])
    turn = np.argsort(-loads, kind="stable")
    loads, dealt = loads[turn], [dealt[lane] for lane in turn]
    #: the documents of all lanes in a row, lane after lane
    listed = np.concatenate([np.array(docs) for docs in dealt])
    begin = np.cumsum(sizes[listed]) - sizes[listed]
    lane_begin = np.cumsum(loads) - loads
    stream = np.concatenate([ids[offsets[doc] : offsets[doc + 1]] for doc in listed.tolist()]).astype(np.int32)
    fresh = np.zeros(len(stream), bool)
    fresh[begin] = True
    logs = np.zeros(len(stream))
    inputs = np.where(fresh, END, np.concatenate([[END], stream[:-1]])).astype(np.int32)
    h = np.zeros((HIDDEN, len(loads)), np.float32)
    t, longest = 0, int(loads[0])
    while t < longest:
        n = int(np.searchsorted(-loads, -t, side="left"))
        steps = min(max(WINDOW, 64 * LANES // n), 512, longest - t)
        at = np.minimum(lane_begin[:n] + t + np.arange(steps)[:, None], len(stream) - 1)
        valid = (t + np.arange(steps)[:, None]) < loads[:n]
        found, h = states(model, inputs[at], fresh[at], h[:, :n])
        good = at[valid]
        logs[good] = token_logs(model, found.reshape(-1, HIDDEN)[valid.reshape(-1)], stream[good])
        t += steps
    out[listed] = np.add.reduceat(logs, begin)
    return out
