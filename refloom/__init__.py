"""Reference-integrity analytics on Spark: definitions, references and the checks that join them."""
