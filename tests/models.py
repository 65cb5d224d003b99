"""Small Python models of the core queries that SQL does not express: name -> rows as tuples in the order of columns."""

import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.json

WORD, SPACE = r"[^\W]", " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def md5(text):
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def ids_md5(ids):
    return md5(",".join(map(str, ids)))


def cleaned(text):
    text = re.sub(r"(\W{1,8})\1{2,}", r"\1", text.strip())
    text = re.sub(r"\b(\w{2,})(?:[\s,.]+\1\b)+", r"\1", text)
    return re.sub(r"\s{2,}", " ", text)


def sentences(text):
    return [s for s in (x.strip() for x in re.sub(r"([.!?])\s+", "\\1\x01", text).split("\x01")) if s]


def clean_text(con):
    return [(k, None if t is None else cleaned(t)) for k, t in con.sql("select doc_id, text from documents where text is not null").fetchall()]


def normalise_clean_wordcount(con):
    out = {}
    for s, t in con.sql("select coalesce(source, 'not available'), text from documents where text is not null and length(text) > 0").fetchall():
        n = len(cleaned(t).split())
        row = out.setdefault(s, [0, 0, 0])
        if n >= 32:
            row[0] += 1
            row[1] += n
        else:
            row[2] += 1
    return [(s, *r) for s, r in out.items()]


def stream_normalise(con):
    rows = [(k, len(cleaned(t).split())) for k, t in con.sql("select doc_id, text from documents where text is not null").fetchall()]
    return [r for r in rows if r[1] >= 32]


def sentence_pack(con):
    out = []
    for k, t in con.sql("select doc_id, text from documents where text is not null").fetchall():
        packs, now = [], []
        for s in sentences(t):
            n = len(s.split())
            if n > 64:
                packs, now = packs + [now], []
            elif sum(len(x.split()) for x in now) + n > 64:
                packs, now = packs + [now], [s]
            else:
                now = now + [s]
        out += [(k, i, " ".join(p), sum(len(x.split()) for x in p)) for i, p in enumerate([p for p in packs + [now] if p])]
    return out


def pair_overlay(con):
    out = []
    for k, ids in con.sql("select item_id, coalesce(input_ids, []) from tokenized_examples").fetchall():
        first = (ids[:64] + [2] * 256)[:256]
        used = sum(first[i] != 2 for i in range(0, 256, 64)) * 64
        second = ids[64:164]
        second = (second or [2])[: 256 - used]
        out.append((k, ids_md5((first[:used] + second + [2] * 256)[:256])))
    return out


def hier_group(con):
    out = []
    for k, ids in con.sql("select item_id, coalesce(input_ids, []) from tokenized_examples").fetchall():
        parts, now = [], []
        for x in ids:
            now = now + [x]
            if x in (13, 198):
                parts, now = parts + [now], []
        groups, held = [], []
        for s in parts + ([now] if now else []):
            if len(held) + len(s) < 128:
                held = held + s
                continue
            if held:
                groups, held = groups + [held], s
                continue
            while len(s) > 127:
                groups, s = groups + [s[:127]], s[128:]
            held = s
        groups = [g[:127] for g in groups + ([held] if held else [])][:8]
        out.append((k, [x for g in groups for x in [0, *g, *[2] * (127 - len(g))]]))
    return out


def _json_lines(con):
    return con.sql("select raw_id, text from raw_records where file_name like '%.jsonl' and text is not null").fetchall()


def _depth(v):
    return 1 + max((_depth(x) for x in (v.values() if isinstance(v, dict) else v)), default=0) if isinstance(v, (dict, list)) else 1


def _status(line):
    if not line.strip():
        return "blank"
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return "bad"
    if not isinstance(value, dict) or _depth(value) > 64:
        return "bad_arrow"
    try:
        pa.json.read_json(pa.BufferReader(line.encode()))
        return "good"
    except pa.ArrowInvalid:
        return "bad_arrow"


def json_line_report(con):
    found = [_status(t) for _, t in _json_lines(con)]
    return [(s, found.count(s)) for s in set(found)]


def json_bad_lines(con):
    bad = [(k, s, t[:80]) for k, t in sorted(_json_lines(con)) for s in [_status(t)] if s.startswith("bad")]
    return bad[:20]


def _repaired(con):
    lines = [re.sub(r"[\r\n]+\Z", "", t) for _, t in _json_lines(con)]
    out = []
    for line in lines:
        if not line.strip() or "\n" in line or "\r" in line:
            continue
        for end, status in (("", "ok"), ('"}', "repaired")):
            try:
                json.loads(line + end)
                out.append(status)
                break
            except (ValueError, RecursionError):
                pass
        else:
            out.append("bad")
    return out


def source_jsonl_repair(con):
    found = _repaired(con)
    return [(s, found.count(s)) for s in set(found)]


def source_skipping(con):
    return [("bad line", _repaired(con).count("bad")), ("unreadable file", 1)]


def tokenizer_cleaned(text):
    def stable(text):
        for _ in range(20):
            text, n = re.subn(r"(\b[\w\-\s;:,.]{1,64}\b)\1{4,}", r"\1", text)
            if not n:
                break
        return text

    text = re.sub(r"\s{2,}", " ", stable(re.sub(r"([^\w])\1{3,}", r"\1", stable(text))))
    while True:
        runs, last = [], text
        for run in re.split(r"([^\x00-\x7f]{2,})", text):
            for charset in ("cp1252", "latin-1") if len(run) > 1 and not run.isascii() else ():
                try:
                    run = run.encode(charset).decode()
                    break
                except UnicodeError:
                    pass
            runs.append(run)
        text = "".join(runs)
        if text == last:
            return text


def clean_tokenizer(con):
    return [(k, None if t is None else md5(tokenizer_cleaned(t))) for k, t in con.sql("select doc_id, text from documents").fetchall()]


def clean_then_encode(con):
    docs = [(k, None if t is None else tokenizer_cleaned(t).split()) for k, t in con.sql("select doc_id, text from documents").fetchall()]
    counts = {}
    for _, ws in docs:
        for w in ws or ():
            counts[w] = counts.get(w, 0) + 1
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:2000]
    number = {w: i + 5 for i, w in enumerate(top)}
    return [(k, len(ws or ()), ids_md5([number.get(w, 1) for w in ws or ()])) for k, ws in docs]


def contrastive_loss(con):
    rows = dict(con.sql("select vec_id, embedding from embeddings").fetchall())
    pairs = [(rows[k], rows[k + 1]) for k in sorted(rows) if k + 1 in rows]
    out = []
    for b in range(0, len(pairs), 32):
        x, y = (np.array([p[i] for p in pairs[b : b + 32]], float) for i in (0, 1))
        x, y = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, y))
        n, loss = len(x), []
        for mine, other in ((x, y), (y, x)):
            for i in range(n):
                logits = [mine[i] @ other[j] / 0.1 for j in range(n)] + [mine[i] @ mine[j] / 0.1 for j in range(n) if j != i]
                loss.append(np.log(np.exp(logits).sum()) - logits[i])
        out.append((b // 32, n, round(float(np.mean(loss)), 5)))
    return out


def interleave_weighted_whole(con):
    queues = {}
    for k, s in con.sql("select doc_id, source from documents where source is not null").fetchall():
        queues.setdefault(s, []).append((md5(f"interleave:{k}"), k))
    queues = {s: [k for _, k in sorted(q)] for s, q in queues.items()}
    total, edge, edges, taken, out = sum(map(len, queues.values())), 1.0, [], dict.fromkeys(queues, 0), []
    for s in sorted(queues, reverse=True):
        edges.append((edge, s))
        edge -= len(queues[s]) / total
    for slot in range(10**9):
        u = int(md5(f"42:{slot}")[:8], 16) / 2**32
        s = [s for e, s in edges if u < e][-1]
        if taken[s] == len(queues[s]):
            return out
        out.append((slot, s, queues[s][taken[s]]))
        taken[s] += 1


def reservoir_shuffle(con):
    """Checked by its parts: the worker of each key comes from Spark's hash, the order within it from CPython's draws."""
    return None


def reservoir(keys, buffer, seed):
    rng, held, out = random.Random(seed), [], []
    for k in keys:
        if len(held) < buffer:
            held.append(k)
            continue
        i = rng.randrange(buffer)
        out.append(held[i])
        held[i] = k
    rng.shuffle(held)
    return out + held
