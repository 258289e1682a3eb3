"""What Python workers keep and burn beside their own task."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

from ledgerline.llm import arrays as A
from ledgerline.llm import maxent_lm as M

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _alone(code: str, **env) -> list[float]:
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": ROOT} | env,
                         capture_output=True, text=True, check=True).stdout
    return [float(x) for x in out.split()[-2:]]


def test_a_worker_gives_back_what_another_operator_left():
    held, left = _alone('''
import numpy as np
from ledgerline.llm import arrays as A
def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
start = mb()
A.claimed("first")["table"] = [np.ones(6_000, np.uint8) for _ in range(20_000)]
pins = [np.ones(6_000, np.uint8) for _ in range(10)]
held = mb() - start
A.claimed("second")
print(held, mb() - start)
''')
    assert held > 100 and left < 40


def test_batches_in_parts_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"x": list(range(600))})
    parts = list(A.small(iter([batch, batch.slice(0, 0)])))
    assert max(map(len, parts)) <= 256 and [x for p in parts for x in p["x"].to_pylist()] == list(range(600))


def test_training_step_is_the_plain_gradient():
    rng = np.random.default_rng(3)
    for size in (6, 7):
        rows, classes = rng.integers(0, 40, (500, 4)) + np.arange(4) * 40, rng.integers(0, size, 500)
        start = rng.normal(size=(160, size)).astype(np.float32)
        bias = rng.normal(size=size).astype(np.float32)
        model, scale = M.Softmax(start.copy(), bias), np.zeros_like(start)
        model.train(scale, rows, classes, 0.15)
        z = start[rows].sum(axis=1, dtype=np.float64) + bias
        g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        g[np.arange(500), classes] -= 1
        plain = start.astype(np.float64)
        for k in range(4):
            sums = np.zeros_like(plain)
            np.add.at(sums, rows[:, k], g)
            plain -= 0.15 * sums / np.sqrt(1 + sums * sums)
        assert np.abs(model.table - plain).max() < 1e-4


def test_words_are_encoded_a_few_at_a_time():
    peak, wrong = _alone('''
import random
import public_tokenizers
from ledgerline.llm import packing as P
def mb(name):
    return int([l for l in open("/proc/self/status") if l.startswith(name)][0].split()[1]) / 1e3
w = P.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
r = random.Random(1)
words = sorted({"".join(r.choices("abcdefgh", k=r.randint(4, 12))).encode() for _ in range(120_000)})
start = mb("VmRSS")
ids, = w.describe(words)
peak = mb("VmHWM") - start
at, wrong = 0, len(words) != len(ids.lengths)
for word, n in list(zip(words, ids.lengths.tolist()))[:9_000]:
    wrong += w.tokenizer.encode(word.decode(), add_special_tokens=False).ids != ids.flat[at:at + n].tolist()
    at += n
wrong += len(w.describe([])[0].lengths)
print(peak, wrong)
''')
    assert peak < 60 and not wrong
