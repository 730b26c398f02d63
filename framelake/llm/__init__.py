"""Operations of a training-data pipeline: each module is one operator.

Nothing else in the library imports this subpackage.
"""
