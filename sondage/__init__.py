"""Sondage: sound a table before modelling it, as DataFrame plans on Spark."""
