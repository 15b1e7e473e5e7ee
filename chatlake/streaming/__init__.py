"""chatlake.streaming"""
