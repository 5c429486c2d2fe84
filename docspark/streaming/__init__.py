"""The batch plans over streams of new documents."""
