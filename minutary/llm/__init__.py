"""Training-data operators: ten over documents and pages, of which the corpus pipeline uses five, two over vectors and one over conversations.

Nothing else in the package imports this one.
"""
