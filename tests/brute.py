"""Answers from plain Python loops, for small data."""

import numpy as np


def box_hits(points, boxes, dims):
    """Hits per qid from two lists of rows."""
    p = np.array([[r[d] for d in dims] for r in points], dtype=np.float32).reshape(-1, len(dims))
    out = {}
    for q in boxes:
        lo = np.array([q[f"l{d}"] for d in dims], dtype=np.float32)
        hi = np.array([q[f"h{d}"] for d in dims], dtype=np.float32)
        out[q["qid"]] = int(((p >= lo) & (p <= hi)).all(axis=1).sum())
    return out


def overlapping(a, b, dims):
    return all(a[f"l{d}"] <= b[f"h{d}"] and b[f"l{d}"] <= a[f"h{d}"] for d in dims)
