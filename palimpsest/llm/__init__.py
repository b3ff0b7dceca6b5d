"""Training-data operators for large text corpora (a leaf subpackage: nothing else imports it)."""
