"""gleaner: vetting of text, configuration and message tables with Spark."""
