"""Training-data operations over large document tables. Nothing else in the
library imports this package."""
