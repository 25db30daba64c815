from tidemark.plans.sort import main

main()
