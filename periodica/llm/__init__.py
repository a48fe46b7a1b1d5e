"""Training-data operators: quality, toxicity, secrets, dedup, decontamination, tokenisation.

Nothing outside this folder imports it; removing the folder leaves the rest of the library whole.
"""
