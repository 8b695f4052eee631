"""Looking at plans, options, previews."""
