"""Operations of a training-data pipeline on texts and their labels. Nothing outside imports this subpackage."""
