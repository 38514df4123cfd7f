"""Shared by the tests of this folder."""

#: Names that operators use inside or return.
CLASHING = ["node", "kept", "n_words", "spans", "candidates", "digest", "seed", "words", "size", "mix_size", "copy_no", "host", "path", "rule", "verdict", "refers_to", "class_id", "dup_doc", "score", "bucket", "label", "w_host", "pii_spans", "doc", "form"]


def prose(draw, n, vocabulary=4000):
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))
