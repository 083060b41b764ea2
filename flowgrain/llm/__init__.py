"""Training-data operators: cleaning, de-duplication, packing and storage of text corpora.

Nothing outside this subpackage (besides ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py``) imports it.
"""
