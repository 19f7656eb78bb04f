"""Readers and writers of the files around the tables: BibTeX, chunk lines, pages, vocabulary, RDF, archives and notes."""
