"""Column functions on texts and on the tokens of a sentence."""
