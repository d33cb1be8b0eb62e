"""casemill: analytics over labelled case corpora and model answers, as plain DataFrame operators."""
