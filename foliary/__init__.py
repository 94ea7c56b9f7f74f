"""Document analytics on Spark: tables of lines, spans, pages and questions, and rules over them as columns."""
