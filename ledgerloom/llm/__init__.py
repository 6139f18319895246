"""Operators for training corpora: scoring, near copies, repeats, packing, languages, fingerprints, chats and token ids."""
