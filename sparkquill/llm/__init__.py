"""Training-data operators: scoring, de-duplication, decontamination, PII, mixing and formatting.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
