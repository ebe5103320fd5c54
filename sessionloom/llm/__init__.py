"""Training-data operators: text, vectors and pages at corpus scale.

Nothing outside this folder imports it; `__spark_entry__` adds its queries only
when the folder is there.
"""
