"""Plain versions that several tests use."""

import numpy as np

from tessera.llm.simhash import fingerprint


def plain_near(texts: dict) -> set:
    """Ids that are the smallest of their component."""
    ids = sorted(texts)
    codes = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {ids[k] for k in set(label.tolist())}
        label = new
