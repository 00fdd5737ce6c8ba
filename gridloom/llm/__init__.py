"""Training-data operators: media, URL rules, mixing, toxicity, neighbours, language, HTML, dedup, packing.

Nothing else in the package imports this folder.
"""
