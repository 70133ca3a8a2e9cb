"""Corpusloom: a PySpark-native engine for recovering, cleaning and cataloguing document corpora."""
