"""Jobs on panels: data sets, replay and metrics, hygiene, selection, corpora, profiles."""
