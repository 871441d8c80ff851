"""Operators on tables of documents: rasters, layout, lines, tables, repair, assembly, evaluation, batches."""
