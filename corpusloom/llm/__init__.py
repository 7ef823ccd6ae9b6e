"""Training-data operators: archives, licences, languages, lines, packing, near-duplicates, scoring, audio, quality, BPE.

Nothing else in the library imports this subpackage.
"""
