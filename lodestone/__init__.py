"""Evidence-grounded question answering at batch scale, as DataFrame transformations."""
