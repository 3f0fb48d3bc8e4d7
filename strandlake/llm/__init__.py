"""Operators that a training-data pipeline needs: filtering, matching, scanning, counting and mixing of text.

Each module holds one operator and states its rules for nulls, empty texts, ties and repeated rows.
Every operator selects the columns it uses first, so further columns of the input never clash.
"""
